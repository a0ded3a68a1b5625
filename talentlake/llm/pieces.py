"""Token ids and token counts of whole texts, pre-token by pre-token.

Byte-pair tokenizers cut a text into pre-tokens whose ids do not depend on
their neighbours, so the ids of a text are those of its pre-tokens joined, and
each distinct pre-token is encoded by the tokenizers library once per memo.
A plain text (printable ASCII, Latin-1 letters, usual white space) is cut by the
tokenizer's own pattern, with its letter and number classes spelled out.  Any other text is cut only at safe boundaries, single
spaces between two characters that are no white space, which no pre-token
reaches over; where a space has other white space beside it, and for
tokenizers of an unknown kind, the text is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from itertools import chain

import numpy as np

_PLAIN = re.compile("[\t\n\r -~À-ÿ]*")
_LETTERS, _NUMBERS = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"  # \p{L} and \p{N} among the characters of a plain text
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _plain_pattern(pattern: str) -> re.Pattern:
    """The pattern for plain texts: classes in brackets lose theirs around the ranges."""
    for name, chars in ((r"\p{L}", _LETTERS), (r"\p{N}", _NUMBERS)):
        pattern = pattern.replace(f"[{name}]", f"[{chars}]").replace(f"?{name}", f"?[{chars}]").replace(name, chars)
    return re.compile(pattern)


class PieceEncoder:
    """Encodes with one tokenizer file; created once per Python worker."""

    MEMO = 700_000  # pre-tokens whose lengths are kept at most
    _made: dict[str, PieceEncoder] = {}

    @classmethod
    def at(cls, path: str) -> PieceEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @classmethod
    def release(cls) -> None:
        """Let go of this worker's encoders and their memos."""
        cls._made.clear()

    def __init__(self, path: str):
        self._lengths: dict[str, int] = {}
        self._word_bytes = BoundedMemo(self._pack_word)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.vocab, self.mode = model.get_piece_size(), "whole"
            self._encode = lambda texts: model.encode(texts, num_threads=1) if texts else []
            self._pack = _packer(self.id_type)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.mode = boundary_mode(spec)
        if self.mode == "keep":
            self.words = _plain_pattern(_BYTE_LEVEL)
        elif self.mode == "drop":
            self.words = _plain_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self._model = tok.model
        self.vocab = tok.get_vocab_size(with_added_tokens=True)
        self._pack = _packer(self.id_type)
        self._encode = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    @property
    def id_type(self) -> np.dtype:
        return np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")

    def lengths(self, texts: list[str]) -> list[int]:
        """Number of ids of each text."""
        return self._each(texts, self._lengths, len, sum)

    def id_bytes(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text in ``id_type``.

        A plain text's pre-tokens go one by one, on their first use, to the
        library's model, which saves gathering the new ones of every batch.
        """
        out: list = [None] * len(texts)
        words, rest = self._word_bytes, []
        words.shrink()
        for k, text in enumerate(texts):
            if self.mode != "whole" and self._is_plain(text):
                out[k] = b"".join(map(words.__getitem__, self._words(text)))
            else:
                rest.append(k)
        if rest:
            for k, raw in zip(rest, self._each([texts[k] for k in rest], {}, self._pack, b"".join)):
                out[k] = raw
        return out

    def _pack_word(self, word: str) -> bytes:
        """Ids of one pre-token; byte-level models read its bytes as printable characters."""
        return self._pack([t.id for t in self._model.tokenize("".join(map(BYTE_CHARS.__getitem__, word.encode())))])

    def _is_plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _words(self, text: str) -> list[str]:
        # the word normaliser lowers character by character, as lower() does for these
        return self.words.findall(text.lower() if self.mode == "drop" else text)

    def _each(self, texts: list[str], memo: dict, value, joined) -> list:
        cuts = [self.cut(t) for t in texts]
        if len(memo) > self.MEMO:
            _shrink(memo, self.MEMO)
        new = list(set(chain.from_iterable(cuts)).difference(memo))
        whole = {w for w in new if len(w) > 200}  # used once, not kept
        memo.update(zip(new, map(value, self._encode(new))))
        out = [joined(map(memo.__getitem__, c)) for c in cuts]
        for w in whole:
            del memo[w]
        return out

    def cut(self, text: str) -> list[str]:
        """Strings whose ids, one after the other, are the ids of the text."""
        if self.mode == "whole":
            return [text]
        if self._is_plain(text):
            return self._words(text)
        pieces = text.split(" ")
        if not all(map(_safe, pieces)):
            return [text]
        return pieces if self.mode == "drop" else [pieces[0], *(" " + p for p in pieces[1:])]


class BoundedMemo(dict):
    """Bytes by key, made on first use; bounded in bytes, and long keys are not kept."""

    LIMIT = 48 << 20
    LONGEST = 48
    ENTRY = 220  # a key's and a value's object and their place in the table

    def __init__(self, make):
        super().__init__()
        self.make, self.size = make, 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= self.LONGEST:
            self[key] = value
            self.size += len(key) + len(value) + self.ENTRY
        return value

    def shrink(self) -> None:
        """Beyond the limit, keep the short keys, which are the frequent ones, if they are under half of it."""
        if self.size > self.LIMIT:
            short = {k: v for k, v in self.items() if len(k) <= 9}
            size = sum(len(k) + len(v) + self.ENTRY for k, v in short.items())
            self.clear()
            self.size = 0
            if size <= self.LIMIT // 2:
                self.update(short)
                self.size = size


def _shrink(memo: dict, limit: int) -> None:
    """Keep the short pre-tokens, which are the frequent ones."""
    short = {w: v for w, v in memo.items() if len(w) <= 9}
    memo.clear()
    if len(short) <= limit // 2:
        memo.update(short)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, the others in order from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


BYTE_CHARS = _byte_chars()


def id_width(path: str) -> int:
    """Bytes of an id in payload files: 2 where the vocabulary allows, else 4."""
    return PieceEncoder(path).id_type.itemsize


def _packer(kind: np.dtype):
    """Ids to little-endian bytes."""
    code = "H" if kind.itemsize == 2 else "I"
    if sys.byteorder == "little":
        return lambda ids: array(code, ids).tobytes()
    return lambda ids: np.asarray(ids, kind).tobytes()


def _safe(piece: str) -> bool:
    """Whether the spaces around this piece are safe boundaries."""
    return piece != "" and not piece[0].isspace() and not piece[-1].isspace()


def boundary_mode(spec: dict) -> str:
    """``keep``: a pre-token takes its leading space (byte-level, no normaliser);
    ``drop``: white space is dropped; ``whole``: no boundary is known to be safe."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    plain = not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens") or [])
    if plain and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "keep"
    kinds = {n["type"] for n in (norm or {}).get("normalizers", [norm] if norm else [])}
    steps = pre.get("pretokenizers", [])
    first = steps[0] if steps else {}
    if (
        plain
        and {"Lowercase"} <= kinds <= {"NFC", "Replace", "Lowercase"}
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert")
        and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "")
        and " ?" not in first["pattern"]["Regex"]
    ):
        return "drop"
    return "whole"


def by_bytes(sizes: list[int], limit: int):
    """Slices of consecutive texts with about ``limit`` bytes each."""
    begin = total = 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > limit:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
