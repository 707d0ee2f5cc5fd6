"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Bytes of words and ids that a worker gathers before it drops those not met since it last did, and what an entry takes besides.
KEPT_BYTES, ENTRY_BYTES = 64_000_000, 200


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LETTERS = bytes(b for b in range(256) if chr(b).isalpha())
_SIMPLE = _LETTERS + b" \n.,"
_LOWER = bytes(ord(chr(b).lower()) if chr(b).isalpha() and len(chr(b).lower()) == 1 and ord(chr(b).lower()) < 256 else b for b in range(256))


#: How the public tokenizer splits lower-cased text, and the same for bytes of Latin-1 that are letters, digits, ASCII marks or white space.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_UNIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[%s]+|[0-9]|[!-/:-@\[-`{-~]+" % _LETTERS)
_KNOWN = _LETTERS + bytes(b for b in range(33, 127) if not chr(b).isalpha()) + b" \t\n\v\f\r"
#: Latin letters, then marks that the tokenizer takes for a token's word of their own; an apostrophe may begin a contraction.
_MARKED = re.compile("([%s]+)([!-&(-/:-@\\[-`{-~]*)" % _LETTERS.decode("latin-1"))


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own without special tokens.

    Words between blanks and line feeds are encoded once and looked up from then on: the tokenizer drops white space, so
    the ids of a text are those of its words in order. (Files for which that doesn't hold, or that tell cases apart, are encoded
    text by text.) Runs of
    Latin letters, perhaps before marks, share the ids of their lower case; new ones are encoded together, without the steps that
    do nothing to lower-case letters, and told apart by the tokens that end a word. What is known is kept in two tables, the
    older of which is dropped when the newer is full; words met again move to the newer. A text of Latin letters, blanks, commas and full stops alone is lower-cased
    and split as bytes, its marks apart from its words; one that has digits and other ASCII marks too is split as the file says,
    where that is as known here.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        probe = "ab cd\nef, gh. Éa"
        self.by_word = bool(self.ends.any()) and self._whole(probe) == b"".join(map(self._whole, probe.split())) and self._whole(probe.upper()) == self._whole(probe.lower()) == self._whole(probe)
        self.marks = {"": b"", **{c: self._whole(c) for c in ".,"}}
        self.plain = self._plain(path) if self.by_word else None
        split = (json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0] if self.plain else {}
        self.units = split.get("pattern") == {"Regex": _SPLIT} and split["behavior"] == "Removed" and split["invert"]
        self.words: dict[str, bytes] = {}
        self.stems: dict[bytes, bytes] = {}  # Latin-1, lower case
        self._turn()

    def _turn(self) -> None:
        self.old = self.words, self.stems
        self.words, self.stems, self.kept = {}, {c.encode(): self.marks[c] for c in ".,"}, 0

    def _plain(self, path: str):
        """The tokenizer for lower-case Latin words between blanks: splits at blanks, bytes as the model spells them. None where that
        gives other ids than the file's own steps for all pairs of letters and some words."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        plain = Tokenizer.from_file(path)
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = sorted(set(_LETTERS.translate(_LOWER).decode("latin-1")))
        probe = " ".join([x + y for x in letters for y in letters] + ["straße", "internationalisation", "don", "t"])
        return plain if plain.encode_batch_fast([probe], add_special_tokens=False)[0].ids == self.tokenizer.encode_batch_fast([probe], add_special_tokens=False)[0].ids else None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids, in bytes of `kind`."""
        if not self.by_word:
            return [self._whole(t) for t in texts]
        if self.kept > KEPT_BYTES:
            self._turn()
        split, tables = [], []
        for t in texts:
            simple = self._simple(t)
            split.append(t.replace("\n", " ").split(" ") if simple is None else simple)
            tables.append(self.words if simple is None else self.stems)
        found = [list(map(table.get, ws)) for table, ws in zip(tables, split, strict=True)]
        gaps = [[i for i, x in enumerate(got) if x is None] if None in got else () for got in found]
        new, stems = set(), set()
        for table, ws, gap in zip(tables, split, gaps, strict=True):
            (stems if table is self.stems else new).update([ws[i] for i in gap])
        if new or stems:
            self._learn(new, stems)
            for table, ws, got, gap in zip(tables, split, found, gaps, strict=True):
                for i in gap:
                    got[i] = table[ws[i]]
        return list(map(b"".join, found))

    def _simple(self, text: str) -> list[bytes] | None:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if raw.translate(None, _SIMPLE) or b".." in raw or b".," in raw or b",." in raw or b",," in raw:
            if not self.units or raw.translate(None, _KNOWN) or b"<|" in raw:  # which begins the special tokens
                return None
            return _UNIT.findall(raw.translate(_LOWER))
        return raw.translate(_LOWER).replace(b".", b" . ").replace(b",", b" , ").split()

    def _learn(self, new: set[str], stems: set[bytes]) -> None:
        """Puts words and stems with their ids into the newer table, from the older one where it has them."""
        shared, other = [], []
        for w in new:
            if (ids := self.old[0].get(w)) is not None:
                self.words[w] = ids
            elif found := _MARKED.fullmatch(w):
                low = found[1].encode("latin-1").translate(_LOWER)
                shared.append((w, low, found[2]))
                if low not in self.stems:
                    stems.add(low)
            else:
                other.append(w)
        ordered = []
        for w in stems:
            if (ids := self.old[1].get(w)) is not None:
                self.stems[w] = ids
            else:
                ordered.append(w)
        if ordered:
            text = b" ".join(ordered).decode("latin-1")
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind) if self.plain else np.frombuffer(self._whole(text), self.kind)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
            if len(cuts) == len(ordered):
                raw, at = ids.tobytes(), 0
                for w, end in zip(ordered, cuts, strict=True):
                    self.stems[w] = raw[at:end]
                    at = end
            else:
                self.stems.update((w, self._whole(w.decode("latin-1"))) for w in ordered)
        for w, low, mark in shared:
            if mark and mark not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {c: self.marks[c] for c in ("", ".", ",")}
                self.marks[mark] = self._whole(mark)
            self.words[w] = self.stems[low] + self.marks[mark] if mark else self.stems[low]
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, self.kind).tobytes()
        self.kept += ENTRY_BYTES * (len(new) + len(stems)) + 2 * sum(map(len, new)) + sum(map(len, stems))
        self.kept += sum(map(len, map(self.words.__getitem__, new))) + sum(map(len, map(self.stems.__getitem__, stems)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker; words stay known from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
