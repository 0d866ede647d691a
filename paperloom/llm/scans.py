"""Text of scanned pages: page furniture, divided words, misread and torn words, and the repaired paragraphs.

1. A record's lines are laid out in one pass: page numbers by their shape, running heads and feet by lines at page
   boundaries that come again after digits are masked and confusable glyphs folded.
2. Words of all records are counted and grouped by their confusable-glyph skeleton. A form is misread when a far more
   frequent form of its group turns into it by known confusions, and, where the two are close in number, the words
   before it support the frequent form.
3. Neighbouring pieces are counted with the words; each different pair is a torn word if its union is far more
   frequent than the rarer piece. A second pass looks up only words outside the most frequent good forms, the two
   halves of divided words and the torn pairs.
4. Paragraphs are put together by SQL windows over the lines.

Defined results: null and empty texts give no row; a repeated row (same table and id) counts once; texts are read
whole, whatever their length; on a tie of two forms the one first in binary order wins.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.names import distance
from paperloom.session import cut, width

#: So many of the most frequent good forms are known to every task (bounded; all other forms are found by a join).
KNOWN = 20_000
#: A frequent form must be so many times as frequent as its misread one; below SURE times the context must agree.
RATIO, SURE = 4, 40
#: A torn word's union must be so frequent.
WHOLE = 5

_CLASS = str.maketrans({**dict.fromkeys("céèêë", "e"), "f": "t", **dict.fromkeys("l1|!", "i"), "9": "g", "q": "g", **dict.fromkeys("0ö6ó", "o"), **dict.fromkeys("uüú", "n"), "b": "h", "8": "h", "5": "s", **dict.fromkeys("äáàâ", "a"), "í": "i", "î": "i"})
# What scans make of a letter or pair, right form first.
CONFUSIONS = [("e", "c"), ("t", "f"), ("i", "l"), ("i", "1"), ("l", "1"), ("l", "i"), ("g", "9"), ("g", "q"), ("o", "0"), ("u", "n"), ("n", "u"), ("h", "b"), ("d", "cl"), ("cl", "d"), ("m", "rn"), ("rn", "m"), ("ü", "ii"), ("ü", "u"), ("ö", "6"), ("ö", "o"), ("ä", "a"), ("nn", "rm"), ("b", "8"), ("s", "5"), ("é", "c"), ("è", "c"), ("ê", "c"), ("ß", "b"), ("ß", "8"), ("i", "|"), ("l", "|"), ("c", "e"), ("f", "t"), ("b", "h"), ("z", "2"), ("w", "vv")]


_TABLE = bytes(ord(_CLASS.get(i, chr(i))) for i in range(256))


def _classed(s: str) -> str:
    """A glyph for each class of confusable ones; all classes lie in Latin-1, where bytes are translated faster."""
    try:
        return s.encode("latin-1").translate(_TABLE).decode("latin-1")
    except UnicodeEncodeError:
        return s.translate(_CLASS)


@lru_cache(200_000)
def skeleton(word: str) -> str:
    """One spelling for all forms of a word that scans confuse."""
    s = _classed(word.lower().replace("ii", "ü").replace("vv", "w").replace("ß", "h"))
    # c and e, l and i are one by now, so cl is ei, and rn may be ru
    return s.replace("ei", "d").replace("rn", "m").replace("rm", "nn")


def explains(right: str, seen: str) -> bool:
    """Whether known confusions turn the right form into the seen one."""
    right, seen = right.lower(), seen.lower()
    if right == seen:
        return False
    ends = {0}  # positions reached in seen, for each position in right
    at: list[set[int]] = [set() for _ in range(len(right) + 1)]
    at[0] = ends
    for i in range(len(right)):
        for j in at[i]:
            if j < len(seen) and right[i] == seen[j]:
                at[i + 1].add(j + 1)
            for a, b in CONFUSIONS:
                if right.startswith(a, i) and seen.startswith(b, j):
                    at[i + len(a)].add(j + len(b))
    return len(seen) in at[len(right)]


_SPLIT = re.compile(r"([^\W_]+)")
_PAGE_WORDS = {skeleton(w) for w in ("Seite", "Page", "S", "Blatt", "P", "Página", "Pagina", "Pág", "Pag", "Feuille", "Hoja", "Sheet")}
_OF_WORDS = {skeleton(w) for w in ("von", "of", "de", "sur", "v", "aus")}
_PAGENO = re.compile(r"^[\s\-—–·•|\[\]().]*(?:([^\W\d_][^\W_]*|5[^\W_]+)\s*[.:]?\s*(?=[\dlIO]))?([\dlIO]{1,3})\s*(?:(/|[^\W_]{1,3})\s*([\dlIO]{1,3}))?[\s\-—–·•|\[\]()]*$")


def is_pageno(line: str) -> bool:
    m = _PAGENO.match(line.strip())
    if not m or not _DIGIT.search(line):
        return False
    if m[1] and skeleton(m[1]) not in _PAGE_WORDS:
        return False
    return not m[3] or m[3] == "/" or skeleton(m[3]) in _OF_WORDS


_GLUED_DIGIT = re.compile(r"(?<=[^\W\d_])[015698](?!\d)|(?<!\d)[015698](?=[^\W\d_])")
_LETTER_FOR = {"0": "o", "1": "l", "5": "s", "6": "o", "9": "g", "8": "b"}
_DIGIT, _DIGITS, _SIGNS, _LONG, _LETTERS = re.compile(r"\d"), re.compile(r"\d+"), re.compile(r"[\W_]+"), re.compile(r"\d{4,}"), re.compile(r"[^\W\d_]{2,}")


def masked(line: str) -> str:
    """A line's letters by confusable classes, each number one sign."""
    s = line.lower().replace("ii", "ü")
    if _DIGIT.search(s):
        s = _DIGITS.sub("ø", _GLUED_DIGIT.sub(lambda m: _LETTER_FOR[m[0]], s).replace("#", "ø"))
    elif "#" in s:
        s = s.replace("#", "ø")
    return _classed(_SIGNS.sub("", s)).replace("ei", "d").replace("rn", "m")


def bodylike(line: str) -> bool:
    words = _LETTERS.findall(line)
    return bool(words) and sum(w[0].islower() for w in words) > 0.45 * len(words)


def layout(text: str) -> tuple[list[str], list[str]]:
    """The lines of a record and the kind of each: running, pageno, blank or body."""
    lines = text.split("\n")
    clean = [x.replace("\x0c", "").replace("\r", "").strip() for x in lines]
    kind = ["blank" if not c else "pageno" if is_pageno(c) else "body" for c in clean]
    feed = [i for i, x in enumerate(lines) if "\x0c" in x]
    body = [i for i, k in enumerate(kind) if k == "body"]
    if len(body) < 2:
        return lines, kind
    keys = {i: masked(clean[i]) for i in body}
    same: dict[str, list[int]] = {}
    for i in body:
        same.setdefault(keys[i], []).append(i)
    # a head or foot keeps its long numbers, whatever its page number; body text that comes again has others
    by_number: dict[tuple, list[int]] = {}
    for i in body:
        if (n := tuple(_LONG.findall(clean[i]))) and not bodylike(clean[i]):
            by_number.setdefault(n, []).append(i)
    for members in by_number.values():
        for i in members:
            if any(j != i and _alike(keys[i], keys[j], 4) for j in members):
                kind[i] = "running"
    feeds = set(feed)
    for _ in range(3):
        # lines next to a page's edge, seen through blanks, page numbers and running lines
        edge: set[int] = set()
        at_edge = True
        for i, k in enumerate(kind):
            if i in feeds or k in ("pageno", "running"):
                at_edge = True
            if k == "body":
                if at_edge:
                    edge.add(i)
                at_edge = False
        at_edge = True
        for i in range(len(kind) - 1, -1, -1):
            if kind[i] in ("pageno", "running"):
                at_edge = True
            if kind[i] == "body":
                if at_edge:
                    edge.add(i)
                at_edge = False
            if i in feeds:
                at_edge = True
        found: set[int] = set()
        groups: list[tuple[str, list[int]]] = []
        for i in sorted(edge):
            if kind[i] != "body" or len(keys[i]) < 4:
                continue
            for key, members in groups:
                if _alike(key, keys[i]):
                    members.append(i)
                    break
            else:
                groups.append((keys[i], [i]))
        for key, members in groups:
            alike = {i for m in members for i in same[keys[m]] if kind[i] == "body"}
            if len(alike) >= 2 and len(alike & edge) >= 0.6 * len(alike) and sum(bodylike(clean[i]) for i in alike) < 0.5 * len(alike):
                found |= alike
        if not found:
            break
        for i in found:
            kind[i] = "running"
    return lines, kind


_CODE = {"running": "r", "pageno": "p", "blank": " ", "body": "b"}


def laid_out(records: DataFrame) -> DataFrame:
    """records(rec_table, rec_id, text) -> the same rows once, with a letter for each line's kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(kinds=["".join(_CODE[k] for k in layout(t)[1]) for t in b.text])

    r = records.select("rec_table", F.col("rec_id").cast("long").alias("rec_id"), "text").where("text is not null and rec_id is not null")
    r = r.repartition(width(r), "rec_table", "rec_id").dropDuplicates(["rec_table", "rec_id"])
    return cut(r.mapInPandas(run, "rec_table string, rec_id long, text string, kinds string"))


_ENDS = re.compile(r"([^\W_]+)([-¬\u00ad])\s*$")
_STARTS = re.compile(r"^\W*?([^\W_]+)")


def body_words(text: str, kinds: str) -> Iterator[tuple]:
    """Of each body line: (line_no, words, their separators before, divided word | None, first word is a rest of one).

    A divided word is (first part, mark, line of the second part, second part).
    """
    lines = text.split("\n")
    body = [i for i, k in enumerate(kinds) if k == "b"]
    rest = False
    for n, i in enumerate(body):
        line = lines[i].replace("\x0c", "").replace("\r", "").rstrip()
        both = _SPLIT.split(line)
        words, parts = both[1::2], both[::2]
        cutted = None
        if line and line[-1] in "-¬\u00ad" and (m := _ENDS.search(line)) and n + 1 < len(body) and not m[1].isdigit():
            after = _STARTS.match(lines[body[n + 1]].replace("\x0c", ""))
            if after and not after[1][0].isdigit():
                cutted = (m[1], m[2], body[n + 1], after[1])
        yield i, words, parts, cutted, rest
        rest = bool(cutted and (cutted[1] != "-" or cutted[3][0].islower()))


@lru_cache(200_000)
def is_word(w: str) -> bool:
    """Letters, perhaps with misread digits among them; no reference number."""
    if w.isalpha():
        return len(w) > 1
    letters = sum(c.isalpha() for c in w)
    return letters >= 2 and letters >= 0.5 * len(w) and sum(c.isdigit() for c in w) <= 3


def pieces(words: list[str], parts: list[str], k: int, rest: bool) -> tuple[str, str] | None:
    """The word before place k and the word there, if a blank between them may have torn one word."""
    if k and parts[k] == " " and not (k == 1 and rest) and words[k][0].islower():
        a, low = words[k - 1].lower(), words[k].lower()
        if a.isalnum() and not a.isdigit() and len(a) + len(low) > 3:
            return a, low
    return None


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forms (with compounds, hyphen kept), pairs of a form with the word before it, and pairs of pieces, counted within each batch."""
    for b in batches:
        seen: Counter = Counter()
        torn: set = set()
        for text, kinds in zip(b.text, b.kinds):
            for _, words, parts, cutted, rest in body_words(text, kinds):
                low = [w.lower() for w in words]
                last = len(low) - 1
                skip = last if cutted and (cutted[1] != "-" or cutted[3][0].islower()) else -1
                good = [is_word(w) for w in low]
                pairs = []
                for k, w in enumerate(low):
                    if (k == 0 and rest) or k == skip:
                        continue
                    if good[k]:
                        pairs.append((w, ""))
                        if k and good[k - 1]:
                            pairs.append((w, low[k - 1]))
                            if parts[k] == "-":
                                pairs.append((f"{low[k - 1]}-{w}", ""))
                    if k and parts[k] == " " and (pair := pieces(words, parts, k, rest)):
                        torn.add(pair)
                seen.update(pairs)
        rows = [(w, p, n, skeleton(w.replace("-", "")), False) for (w, p), n in seen.items()] + [(w, p, 0, skeleton(p + w), True) for p, w in torn]
        yield pd.DataFrame(rows, columns=["form", "before", "n", "skel", "torn"])


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each form's right form, if a far more frequent form of its group turns into it by known confusions."""
    for b in batches:
        rows = []
        for skel, forms in zip(b.skel, b.forms):
            forms = sorted(((f["n"], f["form"]) for f in forms), key=lambda x: (-x[0], x[1]))
            for n, form in forms:
                right = next(((m, g) for m, g in forms if m >= RATIO * n and explains(g, form)), None)
                rows.append((skel, form, n, right[1] if right else None, right[0] if right else None))
        yield pd.DataFrame(rows, columns=["skel", "form", "n", "right", "rn"]).astype({"rn": "Int64"})


def dictionary(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skel, form, n, right): every form of the corpus with its count, and its right form where it is misread.

    With it (skel, a, b): every different pair of neighbouring pieces under the skeleton of its union.
    """
    seen = pages.select("text", "kinds").mapInPandas(_count, "form string, before string, n long, skel string, torn boolean")
    seen = cut(seen.groupBy("form", "before", "skel", "torn").agg(F.sum("n").alias("n")))
    pairs = seen.where("torn").select("skel", F.col("before").alias("a"), F.col("form").alias("b"))
    seen = seen.where("not torn").drop("torn")
    forms = seen.where("before = ''").groupBy("skel").agg(F.collect_list(F.struct("n", "form")).alias("forms"))
    judged = cut(forms.mapInPandas(_judge, "skel string, form string, n long, right string, rn long"))
    # close in number: at least half of the uses must come after words that the frequent form follows more often
    near = judged.where(f"right is not null and rn < {SURE} * n").select("form", "right")
    pair = seen.where("before <> ''").select("form", "before", F.col("n").alias("uses"))
    use = near.join(pair, "form").join(pair.select(F.col("form").alias("right"), "before", F.col("uses").alias("right_uses")), ["right", "before"], "left")
    doubt = use.groupBy("form", "right").agg((F.sum(F.expr("if(right_uses >= uses, uses, 0)")) / F.sum("uses")).alias("share")).where("share < 0.5").select("form", F.lit(True).alias("doubted"))
    return judged.join(doubt, "form", "left").select("skel", "form", "n", F.expr("if(doubted, null, right)").alias("right")), pairs


def _union(whole: str, found: dict[str, tuple]) -> tuple[int, str | None]:
    """Count and right form of a word among the forms of its group; where it is none, those of the form it is misread from."""
    n, right = found.get(whole, (0, None))
    if not n or right:
        best = sorted(((-m, f) for f, (m, r) in found.items() if not r and "-" not in f and explains(f, whole)))
        if best:
            n, right = -best[0][0], best[0][1]
    return n, right


def _unions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for skel, x, y, forms in zip(b.skel, b.a, b.b, b.forms):
            n, right = _union(x + y, {f["form"]: (f["n"], f["right"]) for f in forms})
            if n >= WHOLE:
                rows.append((skel, x, y, n, right or x + y))
        yield pd.DataFrame(rows, columns=["skel", "a", "b", "n", "right"])


def torn_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(skel, a, b, right) of the pairs whose union is far more frequent than the rarer piece; misread pieces count 0."""
    group = words.groupBy("skel").agg(F.collect_list(F.struct("form", "n", "right")).alias("forms"), F.max("n").alias("most")).where(f"most >= {WHOLE}").drop("most")
    u = pairs.join(group, "skel").mapInPandas(_unions, "skel string, a string, b string, n long, right string")
    good = words.where("right is null and form not like '%-%'")
    u = u.join(good.select(F.col("form").alias("a"), F.col("n").alias("na")), "a", "left").join(good.select(F.col("form").alias("b"), F.col("n").alias("nb")), "b", "left")
    return u.where(f"n >= {RATIO} * least(coalesce(na, 0), coalesce(nb, 0))").select("skel", "a", "b", "right")


def _lookups(known: set[str], torn: np.ndarray):
    """torn: sorted checksums of the torn pairs; another pair of equal checksum is asked for and not found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, asked, sums = [], [], []
            for tab, rid, text, kinds in zip(b.rec_table, b.rec_id, b.text, b.kinds):
                for i, words, parts, cutted, rest in body_words(text, kinds):
                    last = len(words) - 1
                    joins = cutted and (cutted[1] != "-" or cutted[3][0].islower())
                    for k, w in enumerate(words):
                        low = w.lower()
                        if (k == 0 and rest) or (k == last and joins):
                            continue
                        if low not in known and is_word(w):
                            rows.append((tab, rid, i, -1, "w", skeleton(low), low, "", ""))
                        if k and parts[k] == " " and (pair := pieces(words, parts, k, rest)):
                            asked.append((tab, rid, i, *pair))
                            sums.append(zlib.crc32(" ".join(pair).encode()))
                    if joins:
                        a, mark, j, c = cutted
                        rows.append((tab, rid, i, j, "h", skeleton((a + c).lower()), a.lower(), c.lower(), mark))
            for at in np.flatnonzero(np.isin(np.array(sums, np.int64), torn)):
                tab, rid, i, a, c = asked[at]
                rows.append((tab, rid, i, -1, "t", skeleton(a + c), a, c, ""))
            yield pd.DataFrame(rows, columns=["rec_table", "rec_id", "line_no", "line2", "ask", "skel", "a", "b", "mark"])

    return run


def _first_difference(right: str, seen: str, at: int) -> int:
    """0 if the misread letters lie before a place in the seen word, 1 if from it on."""
    same = 0
    while same < min(len(right), len(seen)) and right[same] == seen[same]:
        same += 1
    return 0 if same < at else 1


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for tab, rid, i, j, ask, x, y, mark, forms, torn in zip(b.rec_table, b.rec_id, b.line_no, b.line2, b.ask, b.a, b.b, b.mark, b.forms, b.torn):
            found = {f["form"]: (f["n"], f["right"]) for f in forms} if forms is not None else {}
            if ask == "w":
                if x in found and found[x][1]:
                    rows.append((tab, rid, i, "misread", x, found[x][1]))
                continue
            if ask == "t":
                for p in torn if torn is not None else ():
                    if (p["a"], p["b"]) == (x, y):
                        rows.append((tab, rid, i, "misread", f"{x} {y}", p["right"]))
                continue
            whole = x + y
            n, right = _union(whole, found)
            kept = found.get(f"{x}-{y}", (0, None))[0]
            if mark != "-" or n > kept or (n == 0 and kept == 0 and not any(f.replace("-", "") == whole for f in found)):
                rows.append((tab, rid, i, "hyphen", x, y))
                if right and right != whole:
                    line = (i, j)[_first_difference(right, whole, len(x))]
                    rows.append((tab, rid, line, "misread", whole, right))
        yield pd.DataFrame(rows, columns=["rec_table", "rec_id", "line_no", "kind", "seen", "right"])


def damages(pages: DataFrame) -> DataFrame:
    """(rec_table, rec_id, line_no, kind, seen, right) of divided, misread and torn words; pages from laid_out()."""
    words, pairs = dictionary(pages)
    words = cut(words)
    torn = cut(torn_pairs(pairs, words))
    known = {r.form for r in words.where("right is null and form not like '%-%'").orderBy(F.desc("n"), "form").limit(KNOWN).select("form").collect()}
    sums = torn.select(F.crc32(F.concat_ws(" ", "a", "b").cast("binary")).alias("c")).distinct().toPandas().c.to_numpy(np.int64)
    asks = pages.mapInPandas(_lookups(known, np.sort(sums)), "rec_table string, rec_id long, line_no long, line2 long, ask string, skel string, a string, b string, mark string")
    group = words.groupBy("skel").agg(F.collect_list(F.struct("form", "n", "right")).alias("forms"))
    group = group.join(torn.groupBy("skel").agg(F.collect_list(F.struct("a", "b", "right")).alias("torn")), "skel", "left")
    return asks.join(group, "skel", "left").drop("skel").mapInPandas(_decide, "rec_table string, rec_id long, line_no long, kind string, seen string, right string")


def find_damage(records: DataFrame) -> DataFrame:
    """records(rec_table, rec_id, text) -> (rec_table, rec_id, line_no, kind)."""
    pages = laid_out(records)
    lines = pages.select("rec_table", "rec_id", F.posexplode(F.split("kinds", "")).alias("line_no", "code")).where("code in ('r', 'p')")
    furniture = lines.select("rec_table", "rec_id", F.col("line_no").cast("long").alias("line_no"), F.when(F.col("code") == "r", "running").otherwise("pageno").alias("kind"))
    return furniture.unionByName(damages(pages).select("rec_table", "rec_id", "line_no", "kind").distinct())


def repaired(records: DataFrame) -> DataFrame:
    """records(rec_table, rec_id, text) -> (rec_table, rec_id, para_no, text): continuous paragraphs, put together by SQL windows.

    Corrections come to their record once; lines, windows and paragraphs stay in the partition of their record.
    """
    pages = laid_out(records)
    key = ["rec_table", "rec_id"]
    fix = damages(pages).groupBy(*key).agg(F.collect_list(F.struct("line_no", "kind", "seen", "right")).alias("fixes"))

    @F.pandas_udf("array<struct<line_no: long, line: string, code: string, divided: boolean>>")
    def mended(text: pd.Series, kinds: pd.Series, fixes: pd.Series) -> pd.Series:
        out = []
        for t, codes, found in zip(text, kinds, fixes):
            todo: dict[int, list] = {}
            for f in [] if found is None else found:
                todo.setdefault(f["line_no"], []).append(f)
            rows = []
            for i, (x, code) in enumerate(zip(t.split("\n"), codes)):
                if code not in "b ":
                    continue
                x, divided = x.replace("\x0c", "").strip(), False
                for f in todo.get(i, ()):
                    if f["kind"] == "hyphen":
                        divided = True
                    else:
                        right = f["right"]
                        x = re.sub(rf"(?i)(?<![^\W_]){re.escape(f['seen'])}(?![^\W_])", lambda m, r=right: r.capitalize() if m[0][0].isupper() else r, x)
                rows.append({"line_no": i, "line": x, "code": code, "divided": divided})
            out.append(rows)
        return pd.Series(out)

    x = pages.join(fix.hint("merge"), key, "left")
    lines = x.select(*key, F.explode(mended("text", "kinds", "fixes")).alias("l")).select(*key, "l.*")
    w = Window.partitionBy(*key).orderBy("line_no")
    # a blank line ends a paragraph, except where the words before it run on
    body = lines.withColumn("gap", F.lag("code").over(w) == " ").where("code = 'b'")
    body = body.withColumn("open", ~F.coalesce(F.lag("line").over(w).rlike(r"[.!?:;]$"), F.lit(True)))
    body = body.withColumn("starts", (F.coalesce("gap", F.lit(True)) & ~F.col("open")).cast("int")).withColumn("para_no", F.sum("starts").over(w))
    piece = F.when(F.col("divided"), F.regexp_replace("line", "[-¬\u00ad]\\s*$", "")).otherwise(F.concat("line", F.lit(" ")))
    return body.groupBy(*key, "para_no").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("p")))), lambda x: x["p"]), "")).alias("text"))


def _alike(a: str, b: str, part: int = 7) -> bool:
    if a == b:
        return True
    k = max(1, min(len(a), len(b)) // part)
    return abs(len(a) - len(b)) <= k and distance(a, b, k) <= k
