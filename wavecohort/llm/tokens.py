"""Token ids of whole texts by a public vocabulary file (worker-side helper).

``Encoder`` gives the ids that ``Tokenizer.encode(text, add_special_tokens=False)``
gives, as little-endian unsigned 32-bit bytes.  When the vocabulary drops white
space (words never merge across it), a text's ids are the ids of its words one
after the other.  Words are told apart by Arrow for many texts at once.  Where the
vocabulary's other steps are known to cut a word into Latin letters and closing marks
and to map letters to lower case, Arrow does that too, for all distinct words at once
("Word", "word," and "word!!" share the letters' ids), and letters go to the merge
model directly; all other words and vocabularies take the full path.  A distinct part
is encoded once per worker and looked up afterwards.  The table of parts has two
generations of about ``max_words`` parts: a full one becomes the old one, and parts
still in use move on from there (this bounds memory and changes no result).
"""

from __future__ import annotations

import json
import os
import re
from array import array

_LONG_WORD = 64
#: Parts of one generation of the table (about 170 bytes each), by default and where a
#: job does little else than encode.
MAX_WORDS, MANY_WORDS = 100_000, 700_000
#: Latin letters below U+0180 (without U+0130): one code point each in composed
#: form, and so are their lower-case forms.
_LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_LATIN_WORD = re.compile(f"[{_LATIN}]+")
_LETTERS = "".join(c for c in map(chr, range(0x180)) if _LATIN_WORD.fullmatch(c))
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ENCODERS: dict[str, "Encoder"] = {}


def _types(step: dict | None, inner: str) -> list[dict]:
    step = step or {}
    return step.get(inner, [step]) if step else []


def _words_apart(spec: dict) -> bool:
    """Whether the pre-tokenizer removes white space between pieces."""
    first = (_types(spec.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
    return (first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and "\\s" in str(first.get("pattern")))


def _letters_direct(spec: dict) -> bool:
    """Whether a run of letters is composed, lower-cased, kept in one piece and
    mapped byte by byte before the merges, and nothing else, and a run of marks at
    the end of a word is a piece of its own."""
    norm, pre = _types(spec.get("normalizer"), "normalizers"), _types(spec.get("pre_tokenizer"), "pretokenizers")
    return (_words_apart(spec) and spec.get("model", {}).get("type", "BPE") == "BPE"
            and [n.get("type") for n in norm] == ["NFC", "Replace", "Lowercase"] and "\\s+" in str(norm[1].get("pattern"))
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"] and "[\\p{L}]+" in pre[0]["pattern"].get("Regex", "")
            and pre[0]["pattern"]["Regex"].endswith("|[^\\s\\p{L}\\p{N}]+")
            and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
            and not any(re.fullmatch(f"[{_LATIN}]*[{re.escape(_MARKS)}]*", t.get("content", "")) for t in spec.get("added_tokens") or []))


class Encoder:
    def __init__(self, path: str, max_words: int = MAX_WORDS):
        # Spark runs one worker per core already
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.apart, self.direct = _words_apart(spec), _letters_direct(spec)
        self.max_words = max_words
        self.table: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if self.direct:
            self.model = self.tok.model
            as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
            self.bytewise = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(128, 0x180)
                             if _LATIN_WORD.fullmatch(chr(c))}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _distinct(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, from the table where it has them."""
        if len(self.table) > self.max_words:
            self.table, self.old = {}, self.table
        table, old, match, whole = self.table, self.old, _LATIN_WORD.fullmatch, []
        out = list(map(table.get, parts))
        for i in [i for i, x in enumerate(out) if x is None]:
            part = parts[i]
            ids = old.get(part)
            if ids is None:
                if not self.direct or not match(part):
                    whole.append(i)
                    continue
                low = part if part.isascii() else part.lower().translate(self.bytewise)
                ids = array("I", [t.id for t in self.model.tokenize(low)]).tobytes()
            out[i] = ids
            if len(part) <= _LONG_WORD:
                table[part] = ids
        for i, ids in zip(whole, self._whole([parts[i] for i in whole])):
            out[i] = ids
            if len(parts[i]) <= _LONG_WORD:
                table[parts[i]] = ids
        return out

    def _words(self, words):
        """Ids of distinct words (an Arrow array): all ids, and how many each word has."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        parts = words
        if self.direct:
            # letters of A-Z alone are lower-cased here: no other letter becomes one of the class
            low = pc.ascii_lower(words)
            marks = pc.utf8_ltrim(low, characters=_LETTERS)
            split = pc.equal(pc.binary_length(pc.ascii_ltrim(marks, characters=_MARKS)), 0)
            parts = pa.concat_arrays([pc.if_else(split, pc.ascii_rtrim(low, characters=_MARKS), words), pc.if_else(split, marks, "")])
        coded = parts.dictionary_encode()
        ids = self._distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        which = coded.indices.to_numpy().reshape(-1, len(words)).T.ravel()
        return (_gathered(np.frombuffer(b"".join(ids), "<u4"), size, which),
                size[which].reshape(len(words), -1).sum(axis=1))

    def encode(self, texts) -> list[bytes]:
        """Ids of each text (a list, or an Arrow array of strings) as little-endian
        unsigned 32-bit bytes."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.apart or not len(column):
            return self._whole(column.to_pylist())
        split = pc.ascii_split_whitespace(column)
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(column)
        pool, size = self._words(coded.dictionary)
        word = coded.indices.to_numpy()
        flat, ends = _gathered(pool, size, word).tobytes(), np.cumsum(size[word])
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()] * 4
        return [flat[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _gathered(pool, size, which):
    """Runs ``which`` of ``pool`` one after the other; run i has ``size[i]`` ids."""
    import numpy as np
    start, n = np.cumsum(size) - size, size[which]
    ends = np.cumsum(n)
    return pool[np.repeat(start[which] - (ends - n), n) + np.arange(int(ends[-1]))]


def slices(column, rows: int = 1000, size: int = 4 << 20):
    """(first row, rows) of parts of a string column with at most ``rows`` rows and, but
    for single long texts, ``size`` bytes."""
    import numpy as np
    import pyarrow.compute as pc
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = int(upto[at - 1]) if at else 0
        n = max(1, min(rows, int(np.searchsorted(upto, before + size, side="right")) - at))
        yield at, n
        at += n


def encoder(path: str, max_words: int = MAX_WORDS) -> Encoder:
    """One encoder per worker process and vocabulary file, with the largest word table asked for."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, max_words)
    _ENCODERS[path].max_words = max(max_words, _ENCODERS[path].max_words)
    return _ENCODERS[path]
