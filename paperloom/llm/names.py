"""Reading a typed name of a firm or person: legal form, trade, town, family name, given name.

The lexicon of trades and towns comes from the reference list (a small fixed table, its size is checked);
the given names and their short forms are fixed values below.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

#: The reference list is sent to every task; a longer list than this is refused.
MAX_REFERENCE = 50_000

# Words for "missing".
MISSING = {"", "unbekannt", "ka", "na", "keine angabe", "none", "null", "nan", "unknown", "tbd", "nn", "missing", "leer", "fehlt", "ohne", "nicht bekannt", "keine", "n n", "k a", "n a", "ohne angabe", "nicht angegeben", "desconocido", "inconnu"}
# Words of legal forms and titles that name no firm.
LEGAL = {"gmbh", "mbh", "ges", "gesellschaft", "kg", "co", "ag", "se", "ohg", "ek", "ekfm", "kfm", "kommanditges", "kommanditgesellschaft", "aktiengesellschaft", "aktienges", "fa", "firma", "ug", "gbr", "kgaa", "gesmbh", "cokg", "gmbhcokg", "inc", "ltd", "ev", "eg", "cie", "comp", "company", "oh", "offene", "handelsgesellschaft", "handelsges", "eingetragener", "eingetragene", "kaufmann", "kauffrau", "gesellsch", "beschrankter", "haftung", "mit", "der", "die", "das"}
# Words beside a person's name.
TITLES = {"herr", "herrn", "frau", "hr", "fr", "dr", "prof", "dipl", "ing", "privat", "familie", "fam"}
# Legal forms that a field of limited width cuts short.
CUT_LEGAL = ("kommanditgesellschaft", "aktiengesellschaft", "gesellschaft", "eingetragener")
AND = {"u", "und", "and", "et", "y"}
SONS = "sohne"
# Given names, each followed by its short and pet forms.
GIVEN_FORMS = """
andreas andi andy anderl|alexander alex sascha xander lex|barbara babsi barbel babs|benedikt bene ben benno|christian chris|christine christl tina
dietrich didi dieter dietz|elisabeth elsbeth lisa lisbeth else elli sissi liesel|franziska franzi fanny sissy|friedrich fritz fiete fred friedl
gabriele gabi gaby|georg schorsch jorg|gertrud trudi|heinrich heinz heini hein|helene leni lena|hermann|hildegard hilde|ingeborg inge|johannes hannes hans jan johann
josef jupp sepp joseph beppo|jurgen jurg|jochen joachim achim|karl kalle charly|katharina kathi kathe katrin kati tina|ludwig lutz luggi ludi|margarete gretel grete greta margret gretchen
maximilian max maxi|michael michi michel|matthias matze hias|nikolaus klaus niko nick niklas|oskar ossi oscar|peter pit|petra petzi petri|rudolf rudi rolf
susanne susi sanne suse|theodor theo|theresia resi thea theres therese|thomas tom|ulrich uli ulli|viktoria vicky vicki viki vikki|werner|wilhelm willi willy wim|wolfgang wolfi wolf|walter|walburga burgi
gerhard gerd gerda|sebastian basti wastl|stefan steffen steffi|stefanie|ursula uschi ursel|veronika vroni|magdalena leni magda lena|rosa rosi|anna anni anne|maria mitzi marie|philipp|sabine bine|cornelia conny nele|regina gina|eva|emma|paul|otto|erich|ernst|august gustl|eduard edi|ferdinand ferdi|konrad conrad kurt|leonhard leo hardy|lorenz|martin|anton toni|agnes|charlotte lotte|dorothea dora|edith|frieda|irmgard irmi|johanna hanna|klara|luise|renate|sigrid|ozlem|anne|mehmet|aylin|birgit biggi|claudia|jens|sven|torsten|uwe
"""
GIVEN: dict[str, tuple[str, ...]] = {}
for _line in GIVEN_FORMS.replace("\n", "|").split("|"):
    for _form in _line.split():
        GIVEN[_form] = tuple(dict.fromkeys((*GIVEN.get(_form, ()), _line.split()[0])))

# The accented letters of western names without their accents.
_PLAIN = {ord(c): unicodedata.normalize("NFKD", c)[0] for c in "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"} | {ord("ß"): "ss"}
_GLYPH = str.maketrans({"0": "o", "1": "l", "5": "s", "6": "o", "8": "b", "9": "g", "|": "l"})


_MISREAD = re.compile(r"(?<=[a-z])[015689|]+|[015689|]+(?=[a-z])")


def fold(text: str) -> str:
    """Lower case without accents, umlauts in any of their spellings as the plain vowel, misread digits as letters."""
    t = text.lower().translate(_PLAIN)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
        t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    t = _MISREAD.sub(lambda m: m[0].translate(_GLYPH), t)
    return t.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def skeleton(word: str) -> str:
    """A folded word with letters that scans confuse as one."""
    return word.replace("rn", "m").replace("cl", "d").replace("ii", "u").replace("vv", "w")


_OTHER = re.compile(r"[^a-z ]")


def is_missing(text: str | None) -> bool:
    if text is None:
        return True
    letters = _OTHER.sub("", fold(text)).strip()
    return letters in MISSING or letters.replace(" ", "") in MISSING


def mask(word: str) -> int:
    """The letters of a word as bits; an edit adds and removes one letter at most, so masks bound a distance from below."""
    m = 0
    for c in word:
        m |= 1 << (ord(c) & 31)
    return m


def _last_row(a: str, b: str, k: int) -> list[int] | None:
    """Distances of a to each beginning of b in a band of width k; None when all are beyond k."""
    m, big = len(b), k + 1
    before, last = None, [j if j <= k else big for j in range(m + 1)]
    prev = ""
    for i, x in enumerate(a, 1):
        lo, hi = i - k, i + k
        if lo < 1:
            lo = 1
        if hi > m:
            hi = m
        now = [big] * (m + 1)
        least = big
        if i <= k:
            now[0] = least = i
        left = now[lo - 1]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            if x == y:
                v = last[j - 1]
            else:
                v = last[j - 1]
                if last[j] < v:
                    v = last[j]
                if left < v:
                    v = left
                v += 1
                if j > 1 and i > 1 and x == b[j - 2] and prev == y and before[j - 2] + 1 < v:
                    v = before[j - 2] + 1
                if v > big:
                    v = big
            now[j] = left = v
            if v < least:
                least = v
        if least > k:
            return None
        before, last, prev = last, now, x
    return last


def distance(a: str, b: str, k: int) -> int:
    """Edit distance with swaps of neighbours, in a band of width k; k + 1 when it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > k:
        return k + 1
    row = _last_row(a, b, k)
    return k + 1 if row is None else min(row[-1], k + 1)


def slack(length: int) -> int:
    """Edits allowed in a word of a length."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 11 else 3


def prefix_distance(word: str, full: str, k: int) -> int:
    """Least distance of a word to a prefix of a longer one, as in a word cut short."""
    n = len(word)
    row = _last_row(word, full[: n + k], k)
    return k + 1 if row is None else min(min(row[max(3, n - k) :], default=k + 1), k + 1)


def subsequence(word: str, full: str) -> bool:
    rest = iter(full)
    return all(c in rest for c in word)


@dataclass
class Lexicon:
    trades: list[str]
    towns: list[str]
    refs: list[tuple] = field(default_factory=list)  # (ref_id, family, trade, town, sons, code)
    memo: dict = field(default_factory=dict)
    towns_seen: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.trade_masks = [(t, mask(t)) for t in self.trades]
        self.town_masks = [(t, mask(t)) for t in self.towns]

    def trade_of(self, word: str) -> tuple[str, float] | None:
        """The trade a word or a run of words spells, shortens or abbreviates, with a cost."""
        if word in self.memo:
            return self.memo[word]
        best, letters = None, mask(word)
        for t, have in self.trade_masks:
            over = (letters & ~have).bit_count()
            if over > 3:
                continue
            cost = None
            if word == t:
                cost = 0.0
            elif len(word) >= 3 and len(word) < len(t) - 1 and t.startswith(word):
                cost = 0.3
            elif len(word) >= 4 and abs(len(word) - len(t)) <= 3:
                k = slack(len(t))
                if over <= k and (have & ~letters).bit_count() <= k and (d := distance(word, t, k)) <= k:
                    cost = d * 1.0
            if cost is None and over <= 2 and 6 <= len(word) < len(t) and word not in GIVEN:
                k = 1 if len(word) < 8 else 2
                if (d := prefix_distance(word, t, k)) <= k:
                    cost = 0.5 + d
            if cost is None and 4 <= len(word) < len(t) and word[:3] == t[:3] and subsequence(word, t):
                cost = 1.5
            if cost is not None and (best is None or cost < best[1]):
                best = (t, cost)
        self.memo[word] = best
        if len(self.memo) > 500_000:
            self.memo.clear()
        return best

    def town_of(self, word: str) -> str | None:
        """The town a word spells."""
        if word not in self.towns_seen:
            if len(self.towns_seen) > 500_000:
                self.towns_seen.clear()
            self.towns_seen[word] = self._town_of(word)
        return self.towns_seen[word]

    def _town_of(self, word: str) -> str | None:
        letters = mask(word)
        for t, have in self.town_masks:
            if word == t or (len(word) >= 5 and abs(len(word) - len(t)) <= 2 and (letters & ~have).bit_count() <= 2 and (have & ~letters).bit_count() <= 2 and distance(word, t, 1 if len(t) < 8 else 2) <= (1 if len(t) < 8 else 2)):
                return t
        return None


def build_lexicon(rows: list[tuple]) -> Lexicon:
    """rows: (ref_id, ref_name, ref_code, city). In each name the more widely used word is the trade."""
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"the reference list has more than {MAX_REFERENCE} entries")
    towns = sorted({re.sub(r"[^a-z]", "", fold(c)) for *_, c in rows if c})
    parts = []
    for rid, name, code, _ in rows:
        words = [w for w in re.split(r"[^a-z]+", fold(re.sub(r"(?i)\be\.\s?k\.", "", (name or "")))) if w]
        joined = re.sub(r"[^a-z]", "", fold(name or ""))
        town = next((t for t in towns if t in joined and any(t.startswith(w) for w in words)), None)
        rest = [w for w in words if w not in LEGAL and w not in AND and w != SONS and not (town and w in town) and len(w) > 1]
        parts.append((rid, rest, town, SONS in words, re.sub(r"[^a-z]", "", (code or "").lower())))
    count = Counter(w for _, rest, *_ in parts for w in set(rest))
    trades = {max(rest, key=lambda w: (count[w], w)) for _, rest, *_ in parts if len(rest) >= 2}
    trades = sorted(t for t in trades if count[t] >= 3) or sorted(trades)
    refs = []
    for rid, rest, town, sons, code in parts:
        trade = next((w for w in rest if w in trades), "")
        refs.append((rid, "".join(w for w in rest if w != trade), trade, town or "", sons, code))
    return Lexicon(trades, towns, refs)


@dataclass
class Name:
    kind: str  # firm | person | bare
    family: str
    trade: str = ""
    town: str = ""
    given: str = ""  # a given name's fixed form, or one letter
    sons: bool = False
    legal: bool = False


_LEGAL_DOTTED = re.compile(r"(?i)(?<![^\W\d_])(g\.?\s?m\.?\s?b\.?\s?h\.?|ges\.?\s?m\.?\s?b\.?\s?h\.?|o\.\s?h\.\s?g\.?|e\.\s?kfm\.?|e\.?\s?k\.?|a\.\s?g\.|k\.\s?g\.|s\.\s?e\.|u\.\s?g\.)(?![^\W\d_])")


_TOGETHER = re.compile(r"(?<=[a-zäöüß])(?=[A-ZÄÖÜ][a-zäöüß]|[A-Z]{1,2}-)")  # run-together words
_WORDS = re.compile(r"[^a-z]+")


def words_of(text: str) -> list[str]:
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    text = _TOGETHER.sub(" ", text)
    return [w for w in _WORDS.split(fold(text)) if w]


_GIVEN_MASKS = [(g, mask(g)) for g in GIVEN]


@lru_cache(200_000)
def given_of(word: str) -> str | None:
    if word in GIVEN:
        return GIVEN[word][0]
    letters = mask(word)
    if len(word) < 5:
        return next((GIVEN[g][0] for g in GIVEN if len(word) == 4 and len(g) >= 4 and word[0] == g[0] and distance(word, g, 1) <= 1), None)
    best = None
    for g, have in _GIVEN_MASKS:
        k = 1 if len(g) < 6 else 2
        if abs(len(g) - len(word)) <= k and (letters & ~have).bit_count() <= k and (have & ~letters).bit_count() <= k and (d := distance(word, g, k)) <= k and (best is None or d < best[0]):
            best = (d, GIVEN[g][0])
    return best[1] if best else None


def parse(text: str, lex: Lexicon) -> Name | None:
    """The parts of a typed name; None for words for "missing" and texts without letters."""
    if is_missing(text):
        return None
    bare = _LEGAL_DOTTED.sub(" ", text)
    legal = bare != text
    words = words_of(bare)
    rest, sons = [], False
    if any(SONS in w for w in words):
        words = [x for w in words for x in re.sub(r"(?<=[a-z]{4})(?:und|u)?sohne|^(?:und|u)?sohne(?=[a-z]{4})", " sohne ", w).split()]
    joined = not re.search(r"[&+]", text) and not AND & set(words)
    for k, w in enumerate(words):
        if joined and w.endswith("und") and len(w) > 8 and SONS in words[k + 1 : k + 2]:
            w = w[:-3]
        if w in LEGAL or (len(w) >= 4 and any(x.startswith(w) for x in CUT_LEGAL)):
            legal = True
        elif k and k == len(words) - 1 and len(w) in (3, 4) and (w == "gmb" or any(t.startswith(w) for t in lex.towns)):
            continue
        elif w in AND or w in TITLES:
            continue
        elif w in (SONS, "soh", "sohn") or (4 <= len(w) <= 7 and w[0] == "s" and distance(w, SONS, 1) <= 1):
            sons = True
        else:
            rest.append(w)
    if not rest:
        rest = [w for w in words if len(w) > 1]
        if not rest:
            return None
    # the trade: a run of one to three words, never all words
    trade, best = "", None
    for n in (3, 2, 1):
        for i in range(len(rest) - n + 1):
            if n == len(rest) and n == 1:
                continue
            run = rest[i : i + n]
            hit = lex.trade_of("".join(run)) if n == 1 or n < len(rest) else None
            if n == 2 and n < len(rest) and (other := _compound(run, lex)) and (hit is None or other[1] < hit[1]):
                hit = other
            if hit and (best is None or hit[1] - 0.2 * (n - 1) < best[0]):
                best = (hit[1] - 0.2 * (n - 1), i, n, hit[0])
    if best and best[0] > 0.4 and best[2] == 1 and len(rest[best[1]]) <= 4 and not legal and any(given_of(w) for j, w in enumerate(rest) if j != best[1]):
        best = None
    if best is None:
        for i, w in enumerate(rest):
            if len(w) >= 12 and (cutted := _glued(w, lex)):
                a, t, town = cutted
                rest[i : i + 1] = [x for x in (a,) if x]
                trade = t
                if town:
                    rest.append(town)
                break
    if best:
        _, i, n, trade = best
        rest[i : i + n] = []
    town = ""
    for n in (2, 1):
        for i in range(len(rest) - n, -1, -1):
            if not town and len(rest) > n and (t := lex.town_of("".join(rest[i : i + n]))):
                town = t
                rest[i : i + n] = []
    for i, w in enumerate(rest):  # a town run together with what is before it
        for t in lex.towns:
            if not town and len(w) > len(t) + 4 and w.endswith(t):
                town, rest[i] = t, w[: -len(t)]
    if trade or sons or town or (legal and len([w for w in rest if len(w) > 1]) == 1):
        long = [w for w in rest if len(w) > 1]
        return Name("firm", "".join(long or rest), trade, town, "", sons, legal)
    if len(rest) == 1 and len(words) > 1 and "u" in (words[0], words[-1]):
        return Name("person", rest[0], given="u")
    if len(rest) == 1:
        return Name("bare", rest[0], legal=legal)
    if len(rest) == 2:
        a, b = rest
        if len(a) == 1 or len(b) == 1:
            f, g = (b, a) if len(a) == 1 else (a, b)
            return Name("person", f, given=g)
        if "jo" in (a, b):
            return Name("person", b if a == "jo" else a, given="jo")
        ga, gb = given_of(a), given_of(b)
        if ga and gb:
            comma = "," in text.strip().rstrip(",;. ")
            ga, gb = (None, gb) if comma else (ga, None)
        if ga or gb:
            return Name("person", b if ga else a, given=ga or gb)
    return Name("firm" if legal else "bare", "".join(rest), legal=legal)


def _compound(run: list[str], lex: Lexicon) -> tuple[str, float] | None:
    """A trade of two halves, either of them cut short: the first word begins it, the last one ends it."""
    a, b = run[0], run[-1]
    if a == "kfz":
        a = "fz"
    best = None
    ours, theirs = mask(a), mask(b)
    for t in lex.trades:
        if len(a) <= 3 and a[0] == t[0] and len(b) >= 3 and len(b) < len(t) - 2 and t.endswith(b) and subsequence(a, t[: -len(b)]) and (best is None or best[1] > 0.3):
            best = (t, 0.3)
    if len(a) < 2 or len(b) < 2:
        return best
    for t, have in lex.trade_masks:
        if t[:2] != a[:2] or len(a) >= len(t) or (ours & ~have).bit_count() > 1:
            continue
        d1 = 0 if t.startswith(a) else prefix_distance(a, t, 1) if len(a) >= 4 else 9
        if d1 > 1:
            continue
        tail = t[max(2, len(a) - 1) :]
        d2 = 0 if tail.endswith(b) else min((distance(b, t[p:], 2) for p in range(2, len(t) - 2)), default=9) if len(b) >= 4 and (theirs & ~have).bit_count() <= 2 else 9
        if d2 > 2:
            i = 9 if len(b) < 2 else next((0.3 for p in range(2, len(t) - 1) if t[p:].startswith(b)), 9)
            d2 = i
        if d1 + d2 <= 2 and (best is None or d1 + d2 < best[1]):
            best = (t, float(d1 + d2))
    return best


def _glued(w: str, lex: Lexicon) -> tuple[str, str, str] | None:
    """A family and a trade (and a town) written together, in either order."""
    town = next((t for t in lex.towns if w.endswith(t) and len(w) - len(t) > 8), "")
    core = w[: -len(town)] if town else w
    best, letters = None, mask(core)
    for t, have in lex.trade_masks:
        k = 1 if len(t) < 9 else 2
        if (have & ~letters).bit_count() > k:
            continue
        for n in range(len(t) - k, len(t) + k + 1):
            if len(core) - n < 4:
                continue
            for head, tail in ((core[:n], core[n:]), (core[-n:], core[:-n])):
                if head[0] != t[0] and head[-1] != t[-1]:
                    continue
                d = distance(head, t, k)
                if d <= k and (best is None or d < best[0]):
                    best = (d, tail, t)
    if best is None:
        for n in range(min(len(core) - 5, 14), 5, -1):
            if (hit := lex.trade_of(core[-n:])) and hit[1] <= 0.3:
                return core[:-n], hit[0], town
    return (best[1], best[2], town) if best else None
