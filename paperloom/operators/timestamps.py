"""Mixed timestamp formats and zones, normalised to one unambiguous form.

Each value gets an array of every valid interpretation (field order, century, unit of an epoch, which of two
equal wall-clock hours). The site's rules give each interpretation a prior cost, and a Viterbi pass over the
records of one source in record order adds a cost for a switch of format and for a jump back in time. No
interpretation is removed beforehand.

Chains are decoded in blocks of ids. A record is sure when its best interpretation costs less than the next one by
more than its two neighbours could ever give back; what lies between two sure records of a block depends on nothing
outside it. Only the records before the first and after the last sure one of a block are left open, and they are
decoded in a second pass together with the sure records around them, which gives the same result as one chain.

Defined results: null, blank, impossible and unresolvable values give no row; a repeated row (same table and
id) counts once; a null or unknown site gives no zone, so values that need the site's clock read UTC and the
field order of all-number slashed dates is decided by the neighbours in record order, day first on a tie.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut, width

#: Records are decoded in blocks of so many consecutive ids, so that a site with a third of all rows is spread over tasks; no result depends on it.
BLOCK = 8192
#: Costs of a switch of format, of a jump back in time, and of a reading that the site's rules exclude.
SWITCH, BACK, RULE = 1.0, 0.5, 10.0

# Month names of four languages by their first letters, accents removed.
MONTHS = {
    "jan": 1, "ene": 1, "feb": 2, "fev": 2, "mar": 3, "maer": 3, "mrz": 3, "apr": 4, "avr": 4, "abr": 4, "mai": 5, "may": 5,
    "jun": 6, "juin": 6, "jul": 7, "juil": 7, "aug": 8, "aou": 8, "ago": 8, "sep": 9, "set": 9, "okt": 10, "oct": 10,
    "nov": 11, "dez": 12, "dec": 12, "dic": 12,
}
# Zone abbreviations in minutes from UTC.
OFFSETS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
DIGITS = str.maketrans({"O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "g": "9", "b": "6", "G": "6"})
_LIKE = "OoQDlIi|!SsBZzgbG"

_TIME = re.compile(
    r"^(?:\s*[,T]\s*|\s+)(?:(?:à|a las|um|at|ore)\s+)?(\d{1,2})\s?[:.hH]\s?(\d{2})(?:[:.](\d{2})(?:[.,](\d{1,12}))?)?"
    r"\s*(am|pm|a\.\s?m\.?|p\.\s?m\.?)?\s*(?:Uhr|h|hrs)?\s*(?:([+-])(\d{2}):?(\d{2})?|([A-Z]{1,5}))?\s*(?:\[([A-Za-z_/+\-0-9]+)\])?$",
    re.I,
)
_NUM = re.compile(r"^(\d{1,4})\s?([./-])\s?(\d{1,2})\s?\2\s?(\d{1,4})(?!\d)(.*)$", re.S)
_COMPACT = re.compile(r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2})?)?\s*(Z|[+-]\d{2}:?\d{2})?$")
_MONTHDAY = re.compile(r"^(\d{4})-(\d{3})$")
_WEEK = re.compile(r"^(\d{4})-?W(\d{2})-?([1-7])$")
_YM = re.compile(r"^(\d{4})[-/.](\d{1,2})$")
_MY = re.compile(r"^(\d{1,2})[-/.](\d{4})$")
_DAY_NAMED = re.compile(r"^(?:[^\W\d_]{2,12}\.?,?\s+)?(?:le\s+|el\s+)?(\d{1,2})(?:er|st|nd|rd|th|\.|º)?[\s-]*(?:de\s+|of\s+)?([^\W\d_]{3,12})\.?,?[\s-]*(?:de\s+|del\s+)?(\d{4}|\d{2})(?!\d)(.*)$", re.S)
_NAMED_DAY = re.compile(r"^(?:[^\W\d_]{2,12}\.?,\s+)?([^\W\d_]{3,12})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)(.*)$", re.S)
_NAMED_MONTH = re.compile(r"^([^\W\d_]{3,12})\.?\s+(?:de\s+)?(\d{4})$")


def _month(word: str) -> int | None:
    w = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
    return MONTHS.get(w[:4]) or MONTHS.get(w[:3])


_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_SPACE = re.compile(r"\s+")


def _clean(text: str) -> str:
    if text.isascii():
        return _SPACE.sub(" ", _CONTROL.sub("", text)).strip()
    text = "".join(" " if c in " \t\r\n\v\f" else c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\r\n\v\f")
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()


def _redigit(text: str) -> str:
    """Misread digits: a token without other letters that holds a digit, or a value without other letters at all."""
    if not re.search(rf"[^\W\d_{_LIKE}]", text) and re.search(r"\d", text):
        return text.translate(DIGITS)
    return re.sub(rf"(?<![^\W\d_])[\d{_LIKE}]*\d[\d{_LIKE}]*(?![^\W\d_])", lambda m: m[0].translate(DIGITS), text)


def _civil(y: int, m: int, d: int, rest: str, fmt: str, rule: bool = True, two: bool = False) -> list[tuple]:
    """(format, kind, wall clock, offset minutes | zone | None, follows the rule)."""
    if two:
        y += 2000
    if not 1900 <= y <= 2199:
        return []
    try:
        day = date(y, m, d)
    except ValueError:
        return []
    if not rest.strip(" ,."):
        return [(fmt, "day", day, None, rule)]
    t = _TIME.match(rest.rstrip())
    if not t:
        return []
    h, mi, s = int(t[1]), int(t[2]), int(t[3] or 0)
    if t[5]:
        if not 1 <= h <= 12:
            return []
        h = h % 12 + (12 if t[5].lower().startswith("p") else 0)
    if h > 23 or mi > 59 or s > 59:
        return []
    zone: object = None
    if t[6]:
        zone = (int(t[7]) * 60 + int(t[8] or 0)) * (-1 if t[6] == "-" else 1)
    elif t[9]:
        zone = OFFSETS.get(t[9].upper())
        if zone is None:
            return []
    elif t[10]:
        zone = t[10]
    return [(fmt + "t", "moment", datetime(y, m, d, h, mi, s, int(((t[4] or "") + "000000")[:6])), zone, rule)]


def interpretations(value: str) -> list[tuple]:
    """Every valid reading of a value, before the site's zone is applied; see _civil. Rule None: the site's locale decides."""
    text = _clean(value)
    if found := _read(text):
        return found
    digits = _redigit(text)
    return _read(digits) if digits != text else []


def _read(x: str) -> list[tuple]:
    if m := _NUM.match(x):
        a, sep, b, c, rest = m[1], m[2], m[3], m[4], m[5]
        if len(a) == 4:
            return _civil(int(a), int(b), int(c), rest, "ymd" + sep) if len(c) <= 2 else []
        if len(a) > 2 or len(c) not in (2, 4):
            return []
        two = len(c) == 2
        if sep != "/":
            return _civil(int(c), int(b), int(a), rest, "dmy" + sep, True, two)
        return [
            *[(f, k, w, z, "dmy") for f, k, w, z, _ in _civil(int(c), int(b), int(a), rest, "dmy/", True, two)],
            *[(f, k, w, z, "mdy") for f, k, w, z, _ in _civil(int(c), int(a), int(b), rest, "mdy/", True, two)],
        ]
    if re.fullmatch(r"\d{10}", x):
        return [("epoch", "moment", datetime(1970, 1, 1) + timedelta(seconds=int(x)), 0, True)]
    if re.fullmatch(r"\d{13}", x):
        return [("epochms", "moment", datetime(1970, 1, 1) + timedelta(milliseconds=int(x)), 0, True)]
    if re.fullmatch(r"\d{16}", x) and x[0] == "1":
        return [("epochus", "moment", datetime(1970, 1, 1) + timedelta(microseconds=int(x)), 0, True)]
    if m := _COMPACT.match(x):
        rest = ""
        if m[4]:
            rest = f" {m[4]}:{m[5]}:{m[6] or '00'}" + (m[7] or "")
        return _civil(int(m[1]), int(m[2]), int(m[3]), rest, "compact")
    if m := _WEEK.match(x):
        try:
            return [("week", "day", date.fromisocalendar(int(m[1]), int(m[2]), int(m[3])), None, True)]
        except ValueError:
            return []
    if m := _MONTHDAY.match(x):
        d = date(int(m[1]), 1, 1) + timedelta(days=int(m[2]) - 1)
        return [("ordinal", "day", d, None, True)] if d.year == int(m[1]) else []
    if m := _YM.match(x) or _MY.match(x):
        y, mo = (int(m[1]), int(m[2])) if len(m[1]) == 4 else (int(m[2]), int(m[1]))
        return [("month", "month", date(y, mo, 1), None, True)] if 1 <= mo <= 12 and 1900 <= y <= 2199 else []
    if m := _NAMED_DAY.match(x):
        if mo := _month(m[1]):
            return _civil(int(m[3]), mo, int(m[2]), m[4], "Mdy")
    if m := _DAY_NAMED.match(x):
        if mo := _month(m[2]):
            return _civil(int(m[3]), mo, int(m[1]), m[4], "dMy", True, len(m[3]) == 2)
    if m := _NAMED_MONTH.match(x):
        if mo := _month(m[1]):
            return [("Mmonth", "month", date(int(m[2]), mo, 1), None, True)]
    return []


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_zones: dict[str, object] = {}


def _zone(name: str | None):
    if name not in _zones:
        try:
            _zones[name] = ZoneInfo(name) if name else timezone.utc
        except Exception:  # an unknown zone in the value: unresolvable
            _zones[name] = None
    return _zones[name]


def _iso(t: datetime) -> str:
    return f"{t.year:04d}-{t.month:02d}-{t.day:02d}T{t.hour:02d}:{t.minute:02d}:{t.second:02d}.{t.microsecond:06d}Z"


def resolve(found: list[tuple], zone_name: str | None, locale: str | None) -> list[tuple[str, str, float, float]]:
    """(format, normal form, seconds for ordering, prior cost) of each interpretation at a site."""
    out = []
    for fmt, kind, wall, zone, rule in found:
        cost = 0.0
        if rule in ("dmy", "mdy"):
            if locale is not None:
                cost = RULE * ((rule == "mdy") != (locale == "en-US"))
            elif rule == "mdy":
                cost = 0.1
        if kind == "day":
            out.append((fmt, wall.isoformat(), (wall - date(1970, 1, 1)).days * 86400.0, cost))
            continue
        if kind == "month":
            out.append((fmt, wall.isoformat()[:7], (wall - date(1970, 1, 1)).days * 86400.0, cost))
            continue
        if isinstance(zone, int):
            moments = [(wall - timedelta(minutes=zone)).replace(tzinfo=timezone.utc)]
        else:
            tz = _zone(zone if zone is not None else zone_name)
            if tz is None:
                continue
            # fold 0 reads a doubled hour as the earlier instant and moves a skipped hour forward by the gap
            first = wall.replace(tzinfo=tz, fold=0).astimezone(timezone.utc)
            second = wall.replace(tzinfo=tz, fold=1).astimezone(timezone.utc)
            moments = [first] if second <= first else [first, second]
        for k, t in enumerate(moments):
            out.append((fmt, _iso(t), (t - _EPOCH).total_seconds(), cost + RULE * k))
    # a value that can only be read against the site's rules is impossible there
    return out if any(o[3] < RULE for o in out) else []


def sure(readings: list[tuple]) -> bool:
    """Whether one reading is the choice of every chain: no other could win back its cost from both neighbours."""
    if len(readings) < 2:
        return len(readings) == 1
    low, second = sorted(r[3] for r in readings)[:2]
    return second - low > 2 * (SWITCH + BACK)


def viterbi(chain: list[list[tuple]]) -> list[str | None]:
    """The cheapest choice of one interpretation per record; records without any are skipped. Ties: the first listed."""
    out: list[str | None] = [None] * len(chain)
    rows = [i for i, c in enumerate(chain) if c]
    start = 0
    while start < len(rows):
        # a record with one interpretation separates what is before it from what is after it
        if len(chain[rows[start]]) == 1:
            out[rows[start]] = chain[rows[start]][0][1]
            start += 1
            continue
        end = start
        while end < len(rows) and len(chain[rows[end]]) > 1:
            end += 1
        run = rows[max(0, start - 1) : min(len(rows), end + 1)]
        score, back = [c[3] for c in chain[run[0]]], []
        for p, i in zip(run, run[1:]):
            prev, now, nscore, nback = chain[p], chain[i], [], []
            for f, _, t, cost in now:
                best, arg = min((s + SWITCH * (f != g) + BACK * (t < u), k) for k, (s, (g, _, u, _)) in enumerate(zip(score, prev)))
                nscore.append(best + cost)
                nback.append(arg)
            score = nscore
            back.append(nback)
        k = min(range(len(score)), key=score.__getitem__)
        for i, b in zip(reversed(run), [*reversed(back), None]):
            out[i] = chain[i][k][1]
            k = b[k] if b else 0
        start = end
    return out


_COLS = ["rec_table", "owner_scope", "rec_id", "val", "zone_name", "locale"]


def _chains(batches: Iterator[pd.DataFrame], by_block: bool) -> Iterator[tuple[tuple, list[tuple], list[list[tuple]]]]:
    """(key, rows, readings) of each chain of sorted rows; a repeated id counts once."""
    known: dict[str, list[tuple]] = {}
    key, rows, chain = None, [], []
    for b in batches:
        blocks = b.block if by_block else [0] * len(b)
        for tab, scope, block, rid, val, zone, locale in zip(b.rec_table, b.owner_scope, blocks, b.rec_id, b.val, b.zone_name, b.locale):
            scope = scope if isinstance(scope, str) else None
            if (tab, block, scope) != key:
                if rows:
                    yield key, rows, chain
                key, rows, chain = (tab, block, scope), [], []
            if rows and rows[-1][0] == rid:
                continue
            found = known.get(val)
            if found is None:
                if len(known) > 200_000:
                    known.clear()
                found = known[val] = interpretations(val)
            zone, locale = zone if isinstance(zone, str) else None, locale if isinstance(locale, str) else None
            rows.append((rid, val, zone, locale))
            chain.append(resolve(found, zone, locale))
    if rows:
        yield key, rows, chain


_OUT = "rec_table string, rec_id long, normal_form string, state string, owner_scope string, val string, zone_name string, locale string"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decided rows ('done'), open rows at the edges of blocks ('open'), and the sure rows next to the edges once more ('edge')."""
    out: list[tuple] = []
    for (tab, _, scope), rows, chain in _chains(batches, True):
        fixed = [i for i, c in enumerate(chain) if sure(c)]
        first, last = (fixed[0], fixed[-1]) if fixed else (len(chain), -1)
        forms = viterbi(chain[first : last + 1])
        for i, (rid, val, zone, locale) in enumerate(rows):
            if first <= i <= last:
                if forms[i - first] is not None:
                    out.append((tab, rid, forms[i - first], "done", None, None, None, None))
                if i in (first, last):
                    out.append((tab, rid, None, "edge", scope, val, zone, locale))
            elif chain[i]:
                out.append((tab, rid, None, "open", scope, val, zone, locale))
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["rec_table", "rec_id", "normal_form", "state", "owner_scope", "val", "zone_name", "locale"])
            out = []
    yield pd.DataFrame(out, columns=["rec_table", "rec_id", "normal_form", "state", "owner_scope", "val", "zone_name", "locale"])


def _decode_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for (tab, _, _), rows, chain in _chains(batches, False):
        out = [(tab, r[0], f) for r, f, c in zip(rows, viterbi(chain), chain) if f is not None and not sure(c)]
        yield pd.DataFrame(out, columns=["rec_table", "rec_id", "normal_form"])


def _with_sites(records: DataFrame, sites: DataFrame) -> DataFrame:
    s = sites.groupBy("owner_scope").agg(F.min(F.struct("zone_name", "locale")).alias("s")).select("owner_scope", "s.zone_name", "s.locale")
    r = records.select("rec_table", F.col("rec_id").cast("long").alias("rec_id"), "owner_scope", "val").where("val is not null and rec_id is not null")
    return r.join(s, "owner_scope", "left")


def normalise_timestamps(records: DataFrame, sites: DataFrame, block: int = BLOCK) -> DataFrame:
    """records(rec_table, rec_id, owner_scope, val), sites(owner_scope, zone_name, locale) -> (rec_table, rec_id, normal_form).

    One shuffle, by table and block of ids (never by site, so no hot site); sites has one row per site and joins by
    whatever plan its size allows. The second pass sees the open rows of a source and two rows of each of its blocks.
    """
    r = _with_sites(records, sites)
    n = width(records)
    r = r.withColumn("block", F.expr(f"rec_id div {block}"))
    r = r.repartition(n, "rec_table", "block").sortWithinPartitions("rec_table", "block", "owner_scope", "rec_id", "val")
    out = cut(r.select(*_COLS, "block").mapInPandas(_decode, _OUT))
    done = out.where("state = 'done'").select("rec_table", "rec_id", "normal_form")
    source = out.where("state = 'open'").select(F.col("rec_table").alias("t"), F.col("owner_scope").alias("o")).distinct()
    if source.isEmpty():
        return done
    edges = out.where("state <> 'done'").join(source, F.col("rec_table").eqNullSafe(F.col("t")) & F.col("owner_scope").eqNullSafe(F.col("o")), "left_semi")
    edges = edges.repartition(n, "rec_table", "owner_scope").sortWithinPartitions("rec_table", "owner_scope", "rec_id", "val")
    return done.unionByName(edges.select(*_COLS).mapInPandas(_decode_edges, "rec_table string, rec_id long, normal_form string"))


def reading_counts(records: DataFrame, sites: DataFrame) -> DataFrame:
    """(rec_table, readings, settled, n): how many values come into the chain with so many readings, and whether the rules settle them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tab, val, zone, locale in zip(b.rec_table, b.val, b.zone_name, b.locale):
                found = resolve(interpretations(val), zone if isinstance(zone, str) else None, locale if isinstance(locale, str) else None)
                rows.append((tab, len(found), sure(found)))
            yield pd.DataFrame(rows, columns=["rec_table", "readings", "settled"])

    r = _with_sites(records, sites).dropDuplicates(["rec_table", "rec_id"])
    return r.select(*_COLS).mapInPandas(run, "rec_table string, readings long, settled boolean").groupBy("rec_table", "readings", "settled").agg(F.count("*").alias("n"))
