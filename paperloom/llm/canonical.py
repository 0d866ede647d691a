"""Mapping freely typed names of firms to the entries of a reference list.

1. A multi-pattern automaton over the reference names (without legal form, with and without town, words in either
   order) and their codes finds embedded mentions; of the mentions that don't overlap and together cover most letters
   the longest one wins.
2. Remaining values are compared as token sets. A value's tokens are the trade, the town and the family name it
   spells, shortens or misspells, each taken to the nearest token of the list; an inverted index from trade to entries
   gives the candidates, and the entry whose tokens agree best is taken if its family name is within a few edits.
   Without a trade the family name must meet one entry only, a town deciding between two. A value that meets no entry,
   or two equally well, is reported with ref_id 0.

Everything runs in the scan's tasks with the reference list (bounded, see names.MAX_REFERENCE) on each; no shuffle
beyond the removal of repeated rows. Defined results: null, blank and words for "missing" give no row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from paperloom.llm.names import AND, LEGAL, SONS, TITLES, Lexicon, build_lexicon, distance, is_missing, mask, parse, skeleton, words_of

#: A task remembers the answers of so many different values.
MEMORY = 200_000

_SPELT = re.compile(r"(?<= )[a-z](?: [a-z])+(?= )")
_BESIDE = LEGAL | AND | TITLES | {SONS}


class Index:
    """Entries by family name; letter masks and lengths leave few of them to the edit distance."""

    def __init__(self, refs: list[tuple]):
        self.refs = refs
        self.rows = [(len(r[0]), mask(r[0]), r) for r in refs]
        self.masks = np.array([m for _, m, _ in self.rows], np.uint32)
        self.lengths = np.array([len(r[0]) for r in refs], np.int32)

    def nearest(self, fam: str) -> list[tuple]:
        """The entries of least edit distance to a family name, within the edits its length allows."""
        least = 0 if len(fam) < 4 else 1 if len(fam) < 6 else 2 if len(fam) < 9 else 3
        n, ours = len(fam), mask(fam)
        if len(self.rows) < 50:
            return self._best(fam, least, [r for m, have, r in self.rows if abs(m - n) <= least and (have & ~ours).bit_count() <= least and (ours & ~have).bit_count() <= least])
        ours = np.uint32(ours)
        near = (np.abs(self.lengths - n) <= least) & (np.bitwise_count(self.masks & ~ours) <= least) & (np.bitwise_count(ours & ~self.masks) <= least)
        return self._best(fam, least, [self.refs[i] for i in np.flatnonzero(near)])

    @staticmethod
    def _best(fam: str, least: int, refs: list[tuple]) -> list[tuple]:
        best: list[tuple] = []
        for r in refs:
            d = distance(fam, r[0], least)
            if d < least or (d == least and not best):
                best, least = [r], d
            elif d == least:
                best.append(r)
        return best


class Mapper:
    def __init__(self, rows: list[tuple]):
        import ahocorasick

        self.lex: Lexicon = build_lexicon(rows)
        by_trade: dict[str, list[tuple]] = defaultdict(list)
        patterns: dict[str, set[int]] = defaultdict(set)
        for rid, family, trade, town, sons, code in self.lex.refs:
            if code:
                patterns[code].add(rid)
                patterns["".join(words_of(code))].add(rid)
            by_trade[trade].append((skeleton(family), rid, town, sons))
            for words in ((family, trade), (trade, family)):
                core = " ".join(w for w in words if w)
                patterns[core].add(rid)
                if town:
                    patterns[f"{core} {town}"].add(rid)
        patterns.pop("", None)
        self.by_trade = {t: Index(refs) for t, refs in by_trade.items()}
        self.all = Index([r for refs in by_trade.values() for r in refs])
        self.automaton = ahocorasick.Automaton()
        for p, rids in patterns.items():
            self.automaton.add_word(f" {p} ", (len(p), rids))
        if patterns:
            self.automaton.make_automaton()
        self.any = bool(patterns)
        self.known: dict[str, int | None] = {}

    def mention(self, value: str) -> set[int]:
        """The entries named by the longest mention among those that don't overlap and cover most; ties keep the first."""
        if not self.any:
            return set()
        # letters with dots between them are one word
        words = _SPELT.sub(lambda m: m[0].replace(" ", ""), f" {' '.join(words_of(value))} ").split()
        text = f" {' '.join(w for w in words if w not in _BESIDE)} "
        hits = [(end - n, end, rids) for end, (n, rids) in self.automaton.iter(text)]
        if len(hits) < 2:
            return hits[0][2] if hits else set()
        hits.sort(key=lambda h: h[1])
        best: list[tuple] = [(0, ())]  # letters covered and mentions chosen, up to each hit
        for k, (start, end, _) in enumerate(hits):
            before = max((j for j in range(k) if hits[j][1] <= start), default=-1) + 1
            with_it = (best[before][0] + end - start, (*best[before][1], k))
            best.append(max(best[-1], with_it, key=lambda x: x[0]))
        chosen = [hits[k] for k in best[-1][1]]
        return max(chosen, key=lambda h: (h[1] - h[0], -h[0]))[2]

    def find(self, value: str) -> int | None:
        """ref_id, 0 for a name without an entry, None for no name."""
        if value in self.known:
            return self.known[value]
        if len(self.known) > MEMORY:
            self.known.clear()
        out = self.known[value] = self._find(value)
        return out

    def _find(self, value: str) -> int | None:
        if is_missing(value):
            return None
        named = self.mention(value)
        if len(named) == 1:
            return next(iter(named))
        p = parse(value, self.lex)
        if p is None or p.kind == "person":
            return 0
        index = self.by_trade.get(p.trade) if p.trade else self.all
        near = index.nearest(skeleton(p.family)) if index else []
        if p.town and len(near) > 1:
            near = [r for r in near if r[2] == p.town] or [r for r in near if not r[2]]
        if len(near) > 1:
            near = [r for r in near if r[3] == p.sons] if len({r[3] for r in near}) > 1 else near
        return near[0][1] if len(near) == 1 else 0


def map_to_reference(values: DataFrame, rows: list[tuple]) -> DataFrame:
    """values(field_name, rec_id, pos, val) -> (field_name, rec_id, pos, ref_id); rows from entities.reference_rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapper = Mapper(rows)
        for b in batches:
            ref = [mapper.find(v) for v in b.val]
            out = b[["field_name", "rec_id", "pos"]].assign(ref_id=pd.array(ref, "Int64"))
            yield out[out.ref_id.notna()].astype({"ref_id": "int64"})

    picked = values.select("field_name", values["rec_id"].cast("long").alias("rec_id"), values["pos"].cast("long").alias("pos"), "val").where("val is not null")
    return picked.mapInPandas(run, "field_name string, rec_id long, pos long, ref_id long")
