"""Fuzzy search for short licence notices.

A notice that occurs with at most k errors, cut into k + 1 pieces, has one piece that occurs exactly (pigeonhole). Each piece is sought
as it is; every run of whole words that could hold the notice around such a find is a candidate, and the regex library's bounded-error
matching verifies it and counts its edits. Candidates are taken best first, none overlapping another. Words that tell licences apart admit no edit:
they stand in the text as they are, right after the word before them (which may be misspelt). Besides, base phrases are counted exactly,
word by word.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trussline.llm.bytetext import fold, parts

#: Exact phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices that are sought with errors, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("all rights reserved", "all-rights-reserved"),
)
#: Words of each label's notices that tell it from others within the error bound: no edit in them.
EXACT = {"mit": ("mit",), "apache-2": ("2",), "cc-by-nc": ("nc",), "cc-by-sa": ("sa",), "gpl-2": ("gnu", "2"), "gpl-3": ("gnu", "3"), "mpl-2": ("2",)}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 10


class Notice(NamedTuple):
    label: str
    size: int
    edits: int
    pieces: tuple[tuple[int, str], ...]
    text: str
    letters: Counter
    pattern: regex.Pattern


def notice(text: str, label: str, chars_per_edit: int = CHARS_PER_EDIT, exact: tuple[str, ...] = ()) -> Notice:
    k = len(text) // chars_per_edit
    cuts = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
    pieces = tuple((a, text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    words, found, loose = text.split(" "), [], ""
    for i, w in enumerate(words):
        w = w if i == 0 else f" {w}"
        if words[i] in exact:
            found += _loosely(loose, k) + [regex.escape(w) + "(?![^ ])"]
            loose = ""
        elif i + 1 < len(words) and words[i + 1] in exact:  # no edit parts it from the next
            found += _loosely(loose + w[: -len(words[i])], k) + [f"(?:{regex.escape(words[i])}){{e<={k}:[^ ]}}"]
            loose = ""
        else:
            loose += w
    return Notice(label, len(text), k, pieces, text, Counter(text), regex.compile("(?b)" + "".join(found + _loosely(loose, k))))


def _too_unlike(n: Notice, span: str) -> bool:
    """Whether letters alone need more edits than the notice admits: an edit puts in, takes out or changes one."""
    left = Counter(span)
    left.subtract(n.letters)
    return max(sum(v for v in left.values() if v > 0), -sum(v for v in left.values() if v < 0)) > n.edits


def _loosely(text: str, k: int) -> list[str]:
    return [f"(?:{regex.escape(text)}){{e<={k}}}"] if text else []


class Find(NamedTuple):
    start: int  # in the folded text, of code points
    end: int
    label: str
    edits: int
    score: float


def find_notices(folded: str, notices: list[Notice]) -> list[Find]:
    """Finds of each notice in a folded text, in order of place: of its spans of whole words within the bound those of fewest edits, then least start and end, none overlapping another."""
    out: list[Find] = []
    starts: list[int] = []
    ends: list[int] = []
    for n in notices:
        candidates = set()
        for offset, piece in n.pieces:
            at = folded.find(piece)
            while at >= 0:
                if not starts:
                    ends = [i for i, c in enumerate(folded) if c == " "] + [len(folded)]
                    starts = [0, *(e + 1 for e in ends[:-1])]
                first = at - offset
                for i in range(bisect_left(starts, first - n.edits), len(starts)):
                    a = starts[i]
                    if a > first + n.edits:
                        break
                    for j in range(bisect_left(ends, a + n.size - n.edits), len(ends)):
                        if ends[j] > a + n.size + n.edits:
                            break
                        candidates.add((a, ends[j]))
                at = folded.find(piece, at + 1)
        taken: list[tuple[int, int]] = []

        def free(a: int, b: int) -> bool:
            i = bisect_left(taken, (a, b))
            return (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b)

        # spans as they should be come first, and most others lie over one of them
        exact = sorted((a, b) for a, b in candidates if folded[a:b] == n.text)
        rest = []
        for a, b in exact:
            if free(a, b):
                insort(taken, (a, b))
                out.append(Find(a, b, n.label, 0, 1.0))
        for a, b in candidates:
            if free(a, b) and not _too_unlike(n, folded[a:b]):
                m = n.pattern.fullmatch(folded, a, b)
                if m and sum(m.fuzzy_counts) <= n.edits:
                    rest.append((sum(m.fuzzy_counts), a, b))
        for edits, a, b in sorted(rest):
            if free(a, b):
                insort(taken, (a, b))
                out.append(Find(a, b, n.label, edits, 1 - edits / n.size))
    return sorted(out)


def base_places(folded: bytes) -> tuple[int, int | None, int | None, set[str]]:
    """Number of places of base phrases, smallest and largest first word, labels."""
    spaced = b" " + folded + b" "
    n, places, labels = 0, [], set()
    for phrase, label in BASE:
        sought = f" {phrase} ".encode()
        at = spaced.find(sought)
        while at >= 0:
            n += 1
            labels.add(label)
            places.append(at)
            at = spaced.find(sought, at + 1)
    if not places:
        return 0, None, None, labels
    return n, spaced.count(b" ", 0, min(places)), spaced.count(b" ", 0, max(places)), labels


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,edits:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))


def scan_licences(docs: DataFrame, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT, text: str = "text", exact=EXACT) -> DataFrame:
    """Adds to each row of docs: n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Texts are folded: A-Z lower-cased, runs of a-z, 0-9 and non-ASCII characters joined by one space. n_base counts all places of
    base phrases; first_word and last_word are the smallest and largest word they start at, from 0, else null. labels holds base labels and those of
    fuzzy finds, distinct and sorted; score is the best find's 1 - edits / length (1 with a base phrase, 0 without finds); spans
    are fuzzy finds in the folded text. exact gives, by label, the words of its notices that admit no edit. Null and empty texts have no words and score 0. Columns of these names are replaced; other columns and all rows stay.
    """
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), _SPAN]
    names = [x.split()[0] for x in _OUT.split(", ")]
    docs = docs.drop(*names)
    sought = tuple((t, label, tuple(exact.get(label, ()))) for t, label in notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [notice(t, label, chars_per_edit, still) for t, label, still in sought]
        for batch in batches:
            rows = []
            for t in (t for _, texts in parts(batch, text) for t in texts):
                folded = fold(t)
                n_base, first, last, base = base_places(folded)
                finds = find_notices(folded.decode("utf-8", "replace"), known)
                labels = base | {f.label for f in finds}
                score = 1.0 if n_base else max([0.0, *(f.score for f in finds)])
                spans = [{"start": f.start, "end": f.end, "label": f.label, "edits": f.edits} for f in finds]
                rows.append((folded.count(b" ") + 1 if folded else 0, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_pydict({n: batch[n] for n in batch.schema.names} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*carried, _OUT]))
