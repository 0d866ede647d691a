"""Finding and masking personal information in free text with a linear-chain conditional random field.

The tagger's features are words, shapes, endings and short lists of cue words of a token and its neighbours within
four tokens; its weights are fitted on the driver from the small labelled table in pii_labels (ROWS_FITTED letters,
half a minute, once a session) and sent to the tasks. As every feature looks at one token, a task scores each different token once and a text is a sum of gathered
rows; Viterbi runs in numpy over many texts at a time. Spans are trimmed to whole words and digit runs.

One scan, one Arrow pass, no shuffle. Defined results: a null or empty text gives no item and itself as masked text;
texts are read whole; of an item that comes more than once in a document one row is given.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from paperloom.llm.names import GIVEN
from paperloom.llm.pii_labels import GIVEN_NAMES, KINDS, letters

#: Letters drawn from the labelled table, passes over them, and the table's seed.
ROWS_FITTED, PASSES, SEED = 2800, 7, 7
#: Different words that an ending must have to count.
RARE = 8
#: Tokens in a piece of a letter, and pieces in a step of the fit.
PIECE, STEP = 40, 160
#: Given names of the public lists; family names are learnt by shape and place only.
NAMES = {*GIVEN, *(n.lower() for g in GIVEN_NAMES for n in g.split("-"))}
# Words that stand beside items in four languages.
CUES = (
    ("title", re.compile(r"^(herrn?|frau|hr|fr|mr|mrs|ms|miss|mme|mmes|m|madame|monsieur|mlle|sra?|señora?|don|doña|dr|prof|dipl|ing|sir|familie)$")),
    ("idcue", re.compile(r"ausweis|reisepass|passport|pasaporte|passeport|steuer|tax|fisca|sozial|social|versicher|insurance|sécurité|seguridad|security|identi|^dni$|^nie$|^nif$|^id$|personal")),
    ("telcue", re.compile(r"^tel|fon|phone|fax|téléphon|^tél|móvil|mobil|portable|handy|ruf|call|dial|ring|rang|appel|joign|llam|nummer|numéro|númer|number|durchwahl")),
    ("mailcue", re.compile(r"mail|courriel|correo|schreib|write|écri|escri")),
    ("roadcue", re.compile(r"straße$|strasse$|^str$|weg$|gasse$|allee$|platz$|ring$|damm$|ufer$|graben$|brücke$|^rue$|^chemin$|^avenue$|^boulevard$|^quai$|^impasse$|^place$|^road$|^lane$|^street$|^st$|^row$|^close$|^way$|^ave$|^rd$|^drive$|^court$|^calle$|^c$|^avda$|^paseo$|^plaza$|^camino$|^ronda$")),
    ("firmcue", re.compile(r"^(gmbh|kg|ohg|ag|se|ug|mbh|ltd|sarl|söhne|sohn|co|cie|inc|plc|llc)$")),
)
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3, 4)
LABELS = ["O", *[f"{b}-{k}" for k in KINDS for b in "BI"]]
_L = len(LABELS)
#: Every sign of a text falls into one token; white space other than line breaks is marked on the token after it, or left out.
_TOKEN = re.compile(r"[ \t\u00a0]?(?:[^\W\d_]+|\d+|[^\w\s]|_)|\n+|\s")
#: Tokens that a task remembers, and tokens decoded together.
MEMORY, BATCH_TOKENS = 400_000, 60_000


def plain(token: str) -> str | None:
    """A token as the tagger knows it: a blank before it as one space, line breaks as one, other white space None."""
    if token[0] == "\n":
        return "\n"
    if token[0] in " \t\u00a0":
        return " " + token[1:] if len(token) > 1 else None
    return None if token.isspace() else token


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end); the blank before a token isn't part of its place."""
    out = []
    for m in _TOKEN.finditer(text):
        if (t := plain(m[0])) is not None:
            out.append((t, m.start() + (t[0] == " "), m.end()))
    return out


def features(token: str, vocabulary: set[str] | None) -> list[str]:
    w = token.lstrip(" ")
    out = [("ns", "sp", "s2")[len(token) - len(w)]]
    if w == "\n":
        return ["nl"]
    if w.isdigit():
        return [*out, f"d{min(len(w), 12)}", "dig", *([f"zero{min(len(w), 4)}"] if w[0] == "0" and len(w) > 1 else []), *(["w=" + w] if len(w) <= 3 else [])]
    if not w[0].isalpha():
        return [*out, "p=" + w]
    low = w.lower()
    shape = "X" if len(w) == 1 and w.isupper() else "x" if len(w) == 1 else "XX" if w.isupper() else "x+" if w.islower() else "Xx" if w[1:].islower() else "xX"
    out += ["sh=" + shape, f"sh={shape}{out[0]}"]
    for cue, stems in CUES:
        if stems.search(low):
            out += [cue, cue + shape]
    if low in NAMES:
        out += ["given", "given" + shape]
    elif vocabulary is not None and low not in vocabulary:
        out += ["unk", "unk" + shape]
    else:
        out.append("w=" + low)
    if len(w) >= 5:
        out += ["s3=" + low[-3:], "s4=" + low[-4:]]
    if len(w) >= 7:
        out.append("s6=" + low[-6:])
    return out


class _Known(dict):
    """Raw token -> number of its score row, -1 for white space; new tokens are scored when they are asked for."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger

    def __missing__(self, raw: str) -> int:
        t = plain(raw)
        self[raw] = i = -1 if t is None else self.tagger.new_row(t)
        return i


class Tagger:
    """Weights by offset, feature and label, and transitions between labels."""

    def __init__(self, index: dict[str, int], vocabulary: set[str], weights: np.ndarray, trans: np.ndarray):
        self.index, self.vocabulary, self.weights, self.trans = index, vocabulary, weights, trans
        self.forget()

    def forget(self) -> None:
        self.known = _Known(self)
        self.rows: list[np.ndarray] = []
        self.matrix: np.ndarray | None = None

    def new_row(self, token: str) -> int:
        """Scores of a token (offsets x labels)."""
        at = [self.index[f] for f in features(token, self.vocabulary) if f in self.index]
        self.rows.append(self.weights[:, at].sum(1).astype(np.float32) if at else np.zeros((len(OFFSETS), _L), np.float32))
        return len(self.rows) - 1

    def tag(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The label numbers of each list of raw tokens that aren't white space."""
        return [labels for labels, _ in self.tag_places(docs)]

    def tag_places(self, docs: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(label numbers, places of their tokens) of each list of raw tokens."""
        if len(self.known) > MEMORY:
            self.forget()
        get = self.known.__getitem__
        ids = [np.fromiter(map(get, d), np.int64, len(d)) for d in docs]
        places = [np.flatnonzero(x >= 0) for x in ids]
        ids = [x[p] for x, p in zip(ids, places)]
        if self.matrix is None or len(self.matrix) < len(self.rows):
            old = 0 if self.matrix is None else len(self.matrix)
            new = np.stack(self.rows[old:]) if len(self.rows) > old else np.zeros((0, len(OFFSETS), _L), np.float32)
            self.matrix = new if self.matrix is None else np.concatenate([self.matrix, new])
        order = sorted((i for i in range(len(docs)) if len(ids[i])), key=lambda i: -len(ids[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(docs)
        at = 0
        while at < len(order):
            n = max(1, BATCH_TOKENS // len(ids[order[at]]))
            part = order[at : at + n]
            at += n
            for i, tags in zip(part, self._viterbi([self.score(ids[i]) for i in part])):
                out[i] = tags
        return [*zip(out, places)]

    def score(self, ids: np.ndarray) -> np.ndarray:
        e = np.zeros((len(ids), _L), np.float32)
        for k, o in enumerate(OFFSETS):
            if abs(o) >= len(ids):
                continue
            got = self.matrix[ids, k]
            if o < 0:
                e[-o:] += got[:o]
            elif o > 0:
                e[:-o] += got[o:]
            else:
                e += got
        return e

    def _viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Lists are sorted by falling length, so the lists still running are always the first ones."""
        lengths = np.array([len(s) for s in scores])
        T, B = lengths[0], len(scores)
        e = np.zeros((T, B, _L), np.float32)
        for b, s in enumerate(scores):
            e[: len(s), b] = s
        back = np.zeros((T, B, _L), np.int8)
        v = e[0] + self.trans[_L]
        ends = np.zeros((B, _L), np.float32)
        live = B
        alive = np.searchsorted(-lengths, -np.arange(T), side="left")  # lists longer than t
        into = np.ascontiguousarray(self.trans[:_L].T)  # label, label before
        for t in range(1, T):
            now = int(alive[t])
            ends[now:live] = v[now:live]
            live = now
            m = v[:live, None, :] + into
            at = m.argmax(2)
            back[t, :live] = at
            v[:live] = np.take_along_axis(m, at[:, :, None], 2)[:, :, 0] + e[t, :live]
        ends[:live] = v[:live]
        best = np.zeros((T, B), np.int64)
        k = ends.argmax(1)
        for t in range(T - 1, -1, -1):  # a list joins the way back at its last token
            now = int(alive[t])
            best[t, :now] = k[:now]
            k[:now] = back[t, np.arange(now), k[:now]]
        return [best[:n, b] for b, n in enumerate(lengths)]


def _labelled(doc: list[tuple[str, str]]) -> tuple[list[str], list[int]]:
    text, spans = "", []
    for piece, kind in doc:
        if kind:
            spans.append((len(text), len(text) + len(piece), kind))
        text += piece
    toks, labels, k = tokens(text), [], 0
    for _, s, e in toks:
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        if k < len(spans) and spans[k][0] <= s < spans[k][1]:
            labels.append(LABELS.index(("B-" if s == spans[k][0] else "I-") + spans[k][2]))
        else:
            labels.append(0)
    return [t for t, _, _ in toks], labels


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, j], n) for j in range(values.shape[1])], 1)


def fit(rows: int = ROWS_FITTED, passes: int = PASSES, seed: int = SEED) -> Tagger:
    """Maximum likelihood with Adagrad steps on batches; forward and backward sums in numpy."""
    data = [x for x in (_labelled(d) for d in letters(rows, seed)) if x[0]]
    count: dict[str, int] = {}
    named: dict[str, int] = {}
    for toks, labels in data:
        for t, lab in zip(toks, labels):
            w = t.strip(" ").lower()
            if w.isalpha():
                count[w] = count.get(w, 0) + 1
                if LABELS[lab].endswith("name"):
                    named[w] = named.get(w, 0) + 1
    # names are learnt by their shape and place, not by heart
    vocabulary = {w for w, c in count.items() if c >= 5 and named.get(w, 0) < 0.5 * c}
    types: dict[str, int] = {}
    for toks, _ in data:
        for t in toks:
            types.setdefault(t, len(types))
    # endings that few words have say nothing about others
    often = Counter(f for t in types for f in features(t, vocabulary))
    index = {f: i for i, f in enumerate(f for f, n in often.items() if n >= RARE or not re.match(r"s\d=", f))}
    feats = [[index[f] for f in features(t, vocabulary) if f in index] for t in types]
    F_, O = len(index), len(OFFSETS)
    weights, trans = np.zeros((O, F_, _L)), np.zeros((_L + 1, _L))
    for i, a in enumerate(["start", *LABELS]):
        for j, b in enumerate(LABELS):
            if b[0] == "I" and (a == "start" or a == "O" or a[2:] != b[2:]):
                trans[(i - 1) % (_L + 1), j] = -20.0
    frozen = trans < -10
    gw, gt = np.full_like(weights, 1e-3), np.full_like(trans, 1e-3)
    width = max(map(len, feats))
    table = np.full((len(feats), width), F_)
    for i, f in enumerate(feats):
        table[i, : len(f)] = f
    # pieces of a letter between two unlabelled tokens, each with the tokens around it for its features
    seqs = []
    for toks, labels in data:
        row = np.full(len(toks) + 8, -1)
        row[4:-4] = [types[t] for t in toks]
        at = 0
        while at < len(toks):
            end = min(at + PIECE, len(toks))
            while end < len(toks) and (labels[end - 1] or labels[end]):
                end += 1
            seqs.append((row[at : end + 8], np.array(labels[at:end])))
            at = end
    rng = np.random.default_rng(seed)
    order = np.arange(len(seqs))
    for _ in range(passes):
        rng.shuffle(order)
        # pieces of like length go together
        groups = [sorted(order[i : i + 10 * STEP], key=lambda j: len(seqs[j][0])) for i in range(0, len(order), 10 * STEP)]
        batches = [g[i : i + STEP] for g in groups for i in range(0, len(g), STEP)]
        for b in rng.permutation(len(batches)):
            part = [seqs[i] for i in batches[b]]
            B, T = len(part), max(len(y) for _, y in part)
            ids = np.full((B, T + 8), -1)
            gold = np.zeros((B, T), int)
            mask = np.zeros((B, T), bool)
            for b, (s, y) in enumerate(part):
                ids[b, : len(s)] = s
                gold[b, : len(y)] = y
                mask[b, : len(y)] = True
            padded = np.concatenate([weights, np.zeros((O, 1, _L))], 1)
            used = np.unique(ids[ids >= 0])
            place = np.zeros(len(feats) + 1, int)
            place[used] = np.arange(len(used))
            place[-1] = len(used)
            per_type = padded[:, table[used]].sum(2)  # offsets, types, labels
            per_type = np.concatenate([per_type, np.zeros((O, 1, _L))], 1)
            loc = place[ids]
            e = sum(per_type[k, loc[:, 4 + o : 4 + o + T]] for k, o in enumerate(OFFSETS))
            # forward and backward in logs
            A = trans[:_L]
            alpha, beta = np.zeros((T, B, _L)), np.zeros((T, B, _L))
            alpha[0] = e[:, 0] + trans[_L]
            for t in range(1, T):
                m = alpha[t - 1].max(1, keepdims=True)
                step = np.log(np.maximum(np.exp(alpha[t - 1] - m) @ np.exp(A), 1e-300)) + m + e[:, t]
                alpha[t] = np.where(mask[:, t, None], step, alpha[t - 1])
            for t in range(T - 2, -1, -1):
                x = beta[t + 1] + e[:, t + 1]
                m = x.max(1, keepdims=True)
                step = np.log(np.maximum(np.exp(x - m) @ np.exp(A).T, 1e-300)) + m
                beta[t] = np.where(mask[:, t + 1, None], step, 0)
            m = alpha[-1].max(1, keepdims=True)
            z = np.log(np.exp(alpha[-1] - m).sum(1)) + m[:, 0]
            prob = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2) * mask[..., None]
            gold1 = np.eye(_L)[gold] * mask[..., None]
            diff = (prob - gold1) / B
            gtr = np.zeros_like(trans)
            gtr[_L] = diff[:, 0].sum(0)
            for t in range(1, T):
                live = mask[:, t]
                if not live.any():
                    break
                pair = np.exp(alpha[t - 1][live][:, :, None] + A[None] + (e[:, t] + beta[t])[live][:, None, :] - z[live][:, None, None]).sum(0)
                np.subtract.at(pair, (gold[live, t - 1], gold[live, t]), 1)
                gtr[:_L] += pair / B
            gtype = np.zeros((O, len(used) + 1, _L))
            for k, o in enumerate(OFFSETS):
                gtype[k] = _sums(loc[:, 4 + o : 4 + o + T].reshape(-1), diff.reshape(-1, _L), len(used) + 1)
            grad = np.zeros((O, F_ + 1, _L))
            flat = table[used].reshape(-1)
            for k in range(O):
                grad[k] = _sums(flat, np.repeat(gtype[k, :-1], width, axis=0), F_ + 1)
            grad = grad[:, :-1] + 2e-4 * weights
            gw += grad**2
            weights -= 0.15 * grad / np.sqrt(gw)
            gtr[frozen] = 0
            gt += gtr**2
            trans -= 0.15 * gtr / np.sqrt(gt)
    return Tagger(index, vocabulary, weights.astype(np.float32), trans.astype(np.float32))


_MAILISH = re.compile(r"@|\(\s*at\s*\)|\[\s*at\s*\]|\bat\b|＠", re.I)


def spans(text: str, raw: list[str], labels: np.ndarray, places: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items, trimmed to whole words."""
    at = np.flatnonzero(labels)
    if not len(at):
        return []
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    out, k, n = [], 0, len(at)
    while k < n:
        kind = LABELS[labels[at[k]]][2:]
        j = k + 1
        while j < n and at[j] == at[j - 1] + 1 and LABELS[labels[at[j]]] == "I-" + kind:
            j += 1
        first = places[at[k]]
        s, e = int(ends[first]) - len(raw[first]), int(ends[places[at[j - 1]]])
        s += len(raw[first]) > 1 and raw[first][0] in " \t\u00a0"
        k = j
        if (found := checked(text, s, e, kind)) is not None:
            out.append((*found, kind))
    return out


def checked(text: str, s: int, e: int, kind: str) -> tuple[int, int] | None:
    """A span moved to whole words and digit runs, without signs and titles at its ends; None when nothing of its kind is left."""
    if "\n" in text[s:e]:
        e = s + text[s:e].index("\n")
    more = "+-_." if kind == "email" else ""
    gap = re.search(r"\s\s", text[s:e])
    if gap:
        e = s + gap.start()
    while s and (text[s - 1].isalnum() or text[s - 1] in more) and (more or text[s].isalnum()):
        s -= 1
    while e < len(text) and text[e].isalnum() and text[e - 1].isalnum():
        e += 1
    first = "+(" if kind == "phone" else ""
    while first and s and text[s - 1] in first:
        s -= 1
    while s < e and not text[s].isalnum() and text[s] not in first:
        s += 1
    while s < e and not text[e - 1].isalnum() and not (text[e - 1] == "." and _DOTTED.search(text[s:e])):
        e -= 1
    if kind == "name":
        while m := _TITLE.match(text[s:e]):
            s += m.end()
    item = text[s:e]
    if kind == "email":
        return (s, e) if _MAILISH.search(item) else None
    digits = sum(c.isdigit() for c in item)
    if kind == "phone":
        return (s, e) if 6 <= digits <= 16 and not item[-1].isalpha() and not _DATE.fullmatch(item) else None
    if kind == "idnum":
        return (s, e) if digits >= 6 else None
    if kind == "address":
        return (s, e) if digits and re.search(r"[^\W\d_]{2}", item) else None
    return (s, e) if not digits and re.search(r"[^\W\d_]{3}", item) else None


_DATE = re.compile(r"\d{4}-\d\d-\d\d|\d{1,2}([./])\d{1,2}\1\d{4}")
# A full stop that belongs to the item: an initial, or a short word for street.
_DOTTED = re.compile(r"(?:(?:^|[\s,])[^\W\d_]|\b(?:St|Rd|Ave|Ln|Dr|Str))\.$")
# Salutations and titles before a name.
_TITLE = re.compile(r"(?:Herrn?|Frau|Mr|Mrs|Ms|Miss|Mme|Madame|Monsieur|M|Sra?|señora?|Dr|Prof|Dipl|Ing|med)(?:\.\s*|\s+)")


def _tagged(texts: list[str | None], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    toks = [_TOKEN.findall(t) if t else [] for t in texts]
    return [spans(t, d, *y) if t else [] for t, d, y in zip(texts, toks, tagger.tag_places(toks))]


@cache
def _fitted() -> Tagger:
    return fit()


def _state() -> dict:
    t = _fitted()
    return {"index": t.index, "vocabulary": t.vocabulary, "weights": t.weights, "trans": t.trans}


def find_items(docs: DataFrame, state: dict | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, kind, item), each different item of a document once."""
    shared = docs.sparkSession.sparkContext.broadcast(state or _state())  # a few MB, bounded by the labelled table

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(**shared.value)
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                texts = [t if isinstance(t, str) else None for t in part.text]
                rows = []
                for doc, text, found in zip(part.doc_id, texts, _tagged(texts, tagger)):
                    rows += dict.fromkeys((doc, k, text[s:e]) for s, e, k in found)
                yield pd.DataFrame(rows, columns=["doc_id", "kind", "item"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInPandas(run, "doc_id long, kind string, item string")


def mask_items(docs: DataFrame, state: dict | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text) with each item replaced by [KIND]."""
    shared = docs.sparkSession.sparkContext.broadcast(state or _state())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(**shared.value)
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                texts = [t if isinstance(t, str) else None for t in part.text]
                out = []
                for text, found in zip(texts, _tagged(texts, tagger)):
                    for s, e, k in reversed(found):
                        text = f"{text[:s]}[{k.upper()}]{text[e:]}"
                    out.append(text)
                yield pd.DataFrame({"doc_id": part.doc_id, "text": out})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInPandas(run, "doc_id long, text string")
