"""Suppliers: canonical names by aliases, patterns and context, and scores of known suppliers in a text.

The list of known suppliers is a dimension on every task (at most extract.MAX_DIMENSION rows); automata over it read
each text once, so the work doesn't grow with the list. Defined results: null and blank names and texts give no row;
of several matches the one first in the list's order wins.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.extract import MAX_DIMENSION

# How sure each kind of match is.
EXACT, SUBSTRING, REGEX, CONTEXT, RATIO = 0.95, 0.85, 0.90, 0.75, 0.7
_UML = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})
# Digits that scans read for letters.
_CONFUSED = str.maketrans("0l15348", "oiiseab")


def key(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower().translate(_UML)).strip()


def _bounded(df: DataFrame, *order: str) -> list:
    rows = df.limit(MAX_DIMENSION + 1).collect()
    if len(rows) > MAX_DIMENSION:
        raise ValueError(f"more than {MAX_DIMENSION} rows")
    return sorted(rows, key=lambda r: tuple(r[o] for o in order))


def _automaton(words: dict[str, object]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, v in words.items():
        if w:
            a.add_word(w, (w, v))
    if len(a):
        a.make_automaton()
    return a


def canonicalise(names: DataFrame, aliases: DataFrame, patterns: DataFrame, contexts: DataFrame) -> DataFrame:
    """names(rec_id, raw, full_text) -> (rec_id, canonical, confidence, matched, match_type).

    aliases(ord, canonical, alias), patterns(ord, canonical, pattern), contexts(ord, canonical, trigger, word). An alias
    matches when it is equal, equal in its normal form, or one lies in the other and is RATIO of its length; then
    patterns are searched in the name, then triggers in the name whose word stands in the full text.
    """
    al = [(r.canonical, r.alias) for r in _bounded(aliases.where("trim(alias) <> ''").select("ord", "canonical", "alias"), "ord")]
    pa = [(r.canonical, r.pattern) for r in _bounded(patterns.select("ord", "canonical", "pattern"), "ord")]
    cx = [(r.canonical, r.trigger, r.word) for r in _bounded(contexts.select("ord", "canonical", "trigger", "word"), "ord")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        equal: dict[str, int] = {}
        by_lower: dict[str, list[int]] = defaultdict(list)
        for i, (_, alias) in enumerate(al):
            equal.setdefault(alias.lower(), i)
            if key(alias):
                equal.setdefault("\0" + key(alias), i)
            by_lower[alias.lower()].append(i)
        inside = _automaton({w: v[0] for w, v in by_lower.items()})
        compiled = [(c, re.compile(p)) for c, p in pa]
        triggers = defaultdict(list)
        for i, (_, t, _) in enumerate(cx):
            triggers[t.lower()].append(i)
        starts = _automaton(dict(triggers))
        for b in batches:
            lows = {v.lower() for v in b.raw}
            # names that lie in an alias: an automaton over the batch's names reads every alias once
            around: dict[str, int] = {}
            names_ = _automaton(dict.fromkeys(lows, 0))
            for alias, ids in by_lower.items() if len(names_) else ():
                for _, (w, _) in names_.iter(alias):
                    if len(w) >= RATIO * len(alias):
                        around[w] = min(around.get(w, len(al)), ids[0])
            out = []
            for rid, raw, text in zip(b.rec_id, b.raw, b.full_text):
                low = raw.lower()
                hits = [equal[k] for k in (low, "\0" + key(raw)) if k in equal]
                sub = [i for _, (w, i) in inside.iter(low) if len(w) >= RATIO * len(low)] if len(inside) else []
                if low in around:
                    sub.append(around[low])
                if hits or sub:
                    i = min(hits + sub)
                    out.append((rid, al[i][0], EXACT if i in hits else SUBSTRING, al[i][1], "exact" if i in hits else "substring"))
                    continue
                m = next(((c, m[0]) for c, p in compiled if (m := p.search(raw))), None)
                if m:
                    out.append((rid, m[0], REGEX, m[1], "regex"))
                    continue
                whole = text.lower() if isinstance(text, str) else ""
                i = min((i for _, (_, ids) in (starts.iter(low) if len(starts) else ()) for i in ids if cx[i][2].lower() in whole), default=None)
                if i is not None:
                    out.append((rid, cx[i][0], CONTEXT, cx[i][1], "context"))
            yield pd.DataFrame(out, columns=["rec_id", "canonical", "confidence", "matched", "match_type"])

    x = names.where("trim(raw) <> ''").select(F.col("rec_id").cast("long"), "raw", "full_text")
    return x.mapInPandas(run, "rec_id long, canonical string, confidence double, matched string, match_type string")


def plain(text: str) -> str:
    """Lower case, anything but letters and digits one blank."""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text.lower().strip())).strip()


def _words(norm: str) -> set[str]:
    return {w for w in norm.split(" ") if len(w) >= 3}


def _signature(norm: str) -> set[str]:
    n = norm.replace(" ", "")
    return {*sorted({n[i : i + 3] for i in range(len(n) - 2)})[:10]}


def fingerprints(docs: DataFrame, known: DataFrame, top: int = 3) -> DataFrame:
    """docs(doc_id, text), known(name_id, name, aliases) -> (doc_id, rank, name_id, score), the best suppliers of each text.

    1 for the name in the text, 0.95 for an alias, 0.8 for the name with confusable digits, 0.7 times the share of its
    words that the text has, and half the likeness of the first ten trigrams above 0.3; scores above 1 are divided by
    the best one. Ties go to the smaller id.
    """
    rows = [(r.name_id, r.name, [a for a in (r.aliases or []) if a]) for r in _bounded(known.where("trim(name) <> ''").select("name_id", "name", "aliases"), "name_id")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        exact, alias, folded, word, gram = (defaultdict(list) for _ in range(5))
        words, grams = [], []
        for i, (_, name, more) in enumerate(rows):
            n = plain(name)
            exact[name.lower()].append(i)
            folded[n.translate(_CONFUSED)].append(i)
            for a in more:
                alias[plain(a)].append(i)
            words.append(set().union(_words(n), *map(_words, map(plain, more))))
            grams.append(_signature(n))
            for w in words[-1]:
                word[w].append(i)
            for g in grams[-1]:
                gram[g].append(i)
        exact_, alias_, folded_ = (_automaton(dict(x)) for x in (exact, alias, folded))
        found = lambda a, t: {i for _, (_, ids) in a.iter(t) for i in ids} if len(a) else set()
        for b in batches:
            out = []
            for doc, text in zip(b.doc_id, b.text):
                n = plain(text)
                score: dict[int, float] = defaultdict(float)
                for ids, s in ((found(exact_, n), 1.0), (found(alias_, n), 0.95), (found(folded_, n.translate(_CONFUSED)), 0.8)):
                    for i in ids:
                        score[i] += s
                shared: dict[int, int] = defaultdict(int)
                for w in _words(n):
                    for i in word.get(w, ()):
                        shared[i] += 1
                for i, c in shared.items():
                    score[i] += 0.7 * c / len(words[i])
                sig = _signature(n)
                for i in {i for g in sig for i in gram.get(g, ())}:
                    like = len(sig & grams[i]) / len(sig | grams[i])
                    if like > 0.3:
                        score[i] += 0.5 * like
                best = sorted(((-round(s, 9), rows[i][0]) for i, s in score.items()))[:top]
                scale = max(1.0, -best[0][0]) if best else 1.0
                out += [(doc, k + 1, i, round(min(-s / scale, 1.0), 6)) for k, (s, i) in enumerate(best)]
            yield pd.DataFrame(out, columns=["doc_id", "rank", "name_id", "score"])

    return docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, rank int, name_id long, score double")


def without_blocked(candidates: DataFrame, blocked: DataFrame, column: str = "canonical") -> DataFrame:
    """Candidates whose normal form holds none of blocked(word): an anti join on containment, the list on every task."""
    words = [w for r in _bounded(blocked.where("word is not null").select("word"), "word") if (w := key(r.word))]
    from paperloom.functions.text import supplier_key

    return candidates.where(~F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.coalesce(supplier_key(F.col(column)), F.lit("")), w))) if words else candidates
