"""Token ids of whole texts with the tokenizers library, in bounded memory.

Both vocabularies cut texts into words before merging, and a single space between two characters that
aren't white space always starts a new word. So a text's ids are those of its space-separated
pieces one after another, and a piece's ids are kept for when it comes again. Pieces for which this doesn't hold (at
a run of white space, with a special token) have their whole text encoded at once.

Two more places always part words: before punctuation that ends a Latin word, and around a single line break between
other characters. So a piece is a word after its space, or without one (NO_SPACE), or punctuation (NO_SPACE, too).
A new piece that is a Latin word after its space needn't be cut by the library again: many of them go to the library's merging
model in one call, and where each begins or ends shows in its tokens. All other pieces take the library's whole path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np

from tessera.llm.common import trim

#: Bytes that a worker keeps pieces and their ids in, before it keeps those of its last texts that came again only;
#: what a piece takes beside its characters and ids.
CACHE_BYTES, PIECE_BYTES = 128 << 20, 200
#: The same where memory is short, as after other stages in the same worker.
SMALL_CACHE_BYTES = 32 << 20
#: Characters cut into pieces at a time.
SLICE = 2_000_000
#: Words that one call merges.
MERGED = 5_000
#: Marks a piece that no space precedes. Texts that hold it are encoded at once.
NO_SPACE = "\x01"

_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!\"#$%&()*,\-./:;?|]"
_LATIN = re.compile(f"{_LETTER}+")
# Both begin with what is rare, so that a search skips quickly to it.
_BREAK = re.compile(r"\n(?<=\S\n)(?=\S)")
_TAIL = re.compile(rf"{_MARK}(?<={_LETTER}{_MARK}){_MARK}*(?= )")

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str, cache_bytes: int | None = None) -> "Encoder":
    """One encoder of a vocabulary file for each worker, which keeps pieces in cache_bytes (CACHE_BYTES if not given)."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cache_bytes = CACHE_BYTES if cache_bytes is None else cache_bytes
    return _encoders[path]


def forget(path: str) -> None:
    """Lets an encoder go and gives its memory back to the system."""
    _encoders.pop(path, None)
    trim()


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """text in parts of about `size` characters, cut before single spaces between other characters."""
    start, end = 0, size
    while end < len(text):
        at = text.find(" ", end)
        if at < 0 or at + 1 >= len(text):
            break
        if text[at - 1].isspace() or text[at + 1].isspace():
            end = at + 1
            continue
        yield text[start:at]
        start, end = at, at + size
    yield text[start:]


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """ids(texts): the ids as little-endian unsigned 32-bit integers, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes | None] = {}
        self.held = 0
        self.cache_bytes = CACHE_BYTES
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids begin a word (with its space) or, in vocabularies that mark ends, end one.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        letters = byte_letters()
        self.edge[[i for t, i in vocabulary.items() if (t.endswith(suffix) if suffix else t.startswith(letters[32]))]] = True
        self.at_end = bool(suffix)
        #: The same model behind a plain cut at \x00, for words already written in byte letters.
        spec |= {"added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": "\x00"}}
        self.merger = Tokenizer.from_str(json.dumps(spec))
        self.letters = str.maketrans({chr(b): c for b, c in letters.items() if b != 0})

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 256):
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Fills `known` with the ids of pieces; None: this piece depends on what stands beside it."""
        known, words, spaced, bare = self.known, [], [], []
        for p in pieces:
            if _LATIN.fullmatch(p):
                words.append(p)
                continue
            text = p.removeprefix(NO_SPACE)
            if not text or text != "\n" and (text[0].isspace() or text[-1].isspace()) or any(s in text for s in self.special):
                known[p] = None
            else:
                (spaced if text is p else bare).append(p)
        self._merge(words)
        known.update(zip(spaced, self.whole([" " + p for p in spaced])))
        known.update(zip(bare, self.whole([p[1:] for p in bare])))

    def _keep(self, new: list[str], pieces: list[str], which: np.ndarray) -> None:
        """Holds `known` to cache_bytes: beyond, only pieces that came twice or more in the texts at hand stay."""
        known = self.known
        self.held += sum(len(p) + len(known[p] or b"") + PIECE_BYTES for p in new)
        if self.held > self.cache_bytes:
            again = [pieces[i] for i in np.flatnonzero(np.bincount(which, minlength=len(pieces)) > 1)]
            self.known = {p: known[p] for p in again}
            self.held = sum(len(p) + len(x or b"") + PIECE_BYTES for p, x in self.known.items())
            if self.held > self.cache_bytes // 2:
                self.known, self.held = {}, 0

    def _merge(self, words: list[str]) -> None:
        for i in range(0, len(words), MERGED):
            part = words[i : i + MERGED]
            if self.at_end:
                text = self.tokenizer.normalizer.normalize_str(" ".join(part)).replace(" ", "\0")
            else:
                text = " " + "\0 ".join(part)
            text = text.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.edge[ids]) + self.at_end
            if len(at) != len(part):
                self.known.update(zip(part, self.whole([" " + w for w in part])))
                continue
            at = at.tolist()
            bounds = [0, *at] if self.at_end else [*at, len(ids)]
            data = ids.tobytes()
            self.known.update((w, data[4 * x : 4 * y]) for w, x, y in zip(part, bounds, bounds[1:]))

    def batch(self, texts: list[str], begins: bool = True) -> list[bytes]:
        """The ids of texts. Without begins, each is a later slice, with the space it was cut at.

        Texts are cut, pieces counted off and ids put together in Arrow; Python sees each distinct piece once.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        known = self.known
        out: list[bytes | None] = [b"" if not text else None for text in texts]
        at = [i for i, text in enumerate(texts) if text and NO_SPACE not in text]
        marked = []
        for i in at:
            t = _TAIL.sub(rf" {NO_SPACE}\g<0>", _BREAK.sub(f" {NO_SPACE}\n {NO_SPACE}", texts[i]))
            marked.append(NO_SPACE + t if begins else t[1:])
        if at:
            lists = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
            starts = lists.offsets.to_numpy()
            coded = lists.flatten().dictionary_encode()
            pieces, places = coded.dictionary.to_pylist(), coded.indices
            new = [p for p in pieces if p not in known]
            self._learn(new)
            values = [known[p] for p in pieces]
            which = places.to_numpy()
            self._keep(new, pieces, which)
            whole = np.zeros(len(at), bool)
            if None in values:
                whole = np.logical_or.reduceat(np.array([v is None for v in values])[which], starts[:-1])
                values = [v or b"" for v in values]
            ends = np.concatenate([[0], np.cumsum(np.array(list(map(len, values)))[which])])[starts].tolist()
            data = pa.array(values, pa.large_binary()).take(places).buffers()[2]
            data = data.to_pybytes() if data is not None else b""
            for i, alone, x, y in zip(at, whole.tolist(), ends, ends[1:]):
                if not alone:
                    out[i] = data[x:y]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = ids
        return out

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; null is empty. About SLICE characters are in work at a time."""
        held: list[str] = []
        n = 0
        for text in texts:
            text = text or ""
            if len(text) > SLICE and not any(s in text for s in self.special):
                yield from self.batch(held)
                held, n = [], 0
                yield b"".join(self.batch([s], i == 0)[0] for i, s in enumerate(slices(text, SLICE)))
                continue
            held.append(text)
            n += len(text)
            if n > SLICE:
                yield from self.batch(held)
                held, n = [], 0
        yield from self.batch(held)
