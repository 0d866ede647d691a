"""Named queries of the fields read from documents, and SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.text import plain_classifier_text
from paperloom.operators import dates, doctypes, numbers, suppliers
from paperloom.plans.catalog import KEY, L, LINES, M, documents, once, query
from paperloom.session import table

SOLID = f"(select doc_id, row_number() over (partition by doc_id order by line_no) idx, regexp_replace(line, '^\\s+|\\s+$', '', 'g') line from {LINES} where regexp_matches(line, '\\S'))"


def _has(c: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _read(r: str, form: str, pivot: int = 79) -> str:
    if form == "ymd":
        return f"cast(try_strptime(replace({r}, '/', '-'), '%Y-%m-%d') as date)"
    if form == "name":
        part = lambda k: f"regexp_extract({r}, '^(\\d{{1,2}})[-.\\s]+([A-Za-z]+)[-.\\s]+(\\d{{4}})$', {k})"
        months = "case lower(" + part(2) + ") " + " ".join(f"when '{n}' then '{k}'" for n, k in dates.MONTHS.items()) + " end"
        return f"cast(try_strptime({part(1)} || '.' || ({months}) || '.' || {part(3)}, '%d.%m.%Y') as date)"
    d = f"regexp_replace({r}, '[-/]', '.', 'g')"
    if form == "dmyy":
        d = f"(regexp_replace({d}, '\\d{{2}}$', '') || case when right({d}, 2) <= '{pivot}' then '20' else '19' end || right({d}, 2))"
    return f"cast(try_strptime({d}, '%d.%m.%Y') as date)"


def _first(src: str, patterns=dates.PATTERNS, line: str = "line") -> str:
    """(doc_id, idx, d): the first date of each line of a source."""
    hits = " union all ".join(f"select doc_id, idx, {line} line, {k} k, '{form}' form, unnest(regexp_extract_all({line}, '{p}')) raw from {src}" for k, (p, form) in enumerate(patterns))
    d = f"case form when 'ymd' then {_read('raw', 'ymd')} when 'dmy' then {_read('raw', 'dmy')} when 'dmyy' then {_read('raw', 'dmyy')} else {_read('raw', 'name')} end"
    return f"(select doc_id, idx, arg_min(d, row(pl, k)) d from (select doc_id, idx, k, instr(line, raw) pl, {d} d from ({hits})) where d is not null group by 1, 2)"


_ANY = "regexp_extract(line, '\\b\\d{1,2}[.\\-/]\\d{1,2}[.\\-/]\\d{2,4}\\b')"
_ANY_DATE = f"case when regexp_matches({_ANY}, '[.\\-/]\\d{{2}}$') then {_read(_ANY, 'dmyy', 69)} else {_read(_ANY, 'dmy')} end"
_REPORT = f"""select doc_id, arg_min(d, row(-s, pl)) as date, max(s) score from (select *, year(d) between 1990 and 2100 ok from (
 select p.doc_id, c.idx pl, {_ANY_DATE.replace('line', 'c.line')} d, 100 + case when regexp_matches(lower(c.line), '\\bvom\\b') then 50 else 0 end + case when p.mark then 40 else 0 end - 5 * (c.idx - p.idx) s
 from (select *, {_has('lower(line)', dates.BESIDE)} mark from {SOLID} where not regexp_matches(lower(line), '{dates.EXCLUDED}') and doc_id in (select doc_id from documents where {_has('lower(text)', dates.REPORT)})) p
 join {SOLID} c on p.doc_id = c.doc_id and c.idx between p.idx and p.idx + case when p.mark then 2 else 0 end
 where (p.mark or regexp_matches(lower(p.line), '\\bvom\\b')) and not regexp_matches(lower(c.line), '{dates.EXCLUDED}'))) where ok group by doc_id"""


@query(_REPORT)
def d12_report_dates(s, d):
    return dates.report_dates(documents(s, d))


def _scored() -> str:
    rows = " union all ".join(
        f"select doc_id, line_no, line, '{kind}' kind, unnest(regexp_extract_all(line, '{dates.PATTERNS[k][0]}')) raw from {LINES} where not regexp_matches(lower(line), '{dates.EXCLUDED}')" for k, kind in ((2, "de"), (4, "de"), (0, "iso"), (8, "month_name"))
    )
    named = "kind = 'month_name'"
    word = lambda w, a, b: f"case when contains(low, '{w}') then case when {named} then {a} else {b} end else 0 end"
    score = f"case when {named} then 60 else 10 end + {word('datum', 40, 50)} + {word('liefer', 20, 30)} + {word('rechnung', 20, 20)} + {word('bericht', 15, 15)} + case when regexp_matches(low, '\\bvom\\b') then 35 else 0 end"
    d = f"case kind when 'iso' then {_read('raw', 'ymd')} when 'de' then {_read('raw', 'dmy')} else {_read('raw', 'name')} end"
    return f"(select doc_id, arg_min(d, k) d, arg_min(kind, k) kind, max(s) s from (select *, row(-s, line_no, instr(line, raw), d) k from (select *, {score} s, {d} d from (select *, lower(line) low from ({rows}))) where year(d) between 1990 and 2100) group by doc_id)"


@query(f"select coalesce(x.doc_id, r.doc_id) doc_id, coalesce(r.date, x.d) as date, case when r.date is not null then 'report_date' else 'score_' || x.s || '_type_' || x.kind end reason from {_scored()} x full join ({_REPORT}) r on x.doc_id = r.doc_id")
def d10_best_dates(s, d):
    return dates.best_dates(documents(s, d))


@query(f"select doc_id, arg_min(d, idx) as date from {_first('(select doc_id, line_no idx, line from ' + LINES + ')')} group by doc_id")
def d16_first_dates(s, d):
    return dates.first_dates(documents(s, d))


def _priority() -> str:
    beleg = ("beleg-datum", "belegdatum", "beleg datum")
    after = " union all ".join(f"select doc_id, idx, {k} k, d from {_first(f'(select * from s where contains(low, {chr(39)}{w}{chr(39)}))', dates.PATTERNS, f'substr(line, instr(low, {chr(39)}{w}{chr(39)}) + {len(w)})')}" for k, w in enumerate(beleg))

    def rule(k: int, labels, barred, how: str) -> str:
        where = _has("low", labels) + (f" and not {_has('low', barred)}" if barred else "")
        pick = "coalesce(f0.d, f1.d)" if how != "after" else "coalesce(f0.d, f1.d, g0.d, g1.d)"
        more = " left join f g0 on g0.doc_id = r.doc_id and g0.idx = r.idx left join f g1 on g1.doc_id = r.doc_id and g1.idx = r.idx + 1" if how == "after" else ""
        t = {"any": "f", "dash": "da", "after": "af"}[how]
        return f"select {k} k, r.doc_id, {pick} d from (select doc_id, min(idx) idx from s where {where} group by 1) r left join {t} f0 on f0.doc_id = r.doc_id and f0.idx = r.idx left join {t} f1 on f1.doc_id = r.doc_id and f1.idx = r.idx + 1{more}"

    rules = " union all ".join(rule(k, labels, barred, how) for k, (_, labels, barred, how) in enumerate(dates.PRIORITIES))
    pickup = f"select -1 k, o.doc_id, o.d from ({rule(0, ('abholdatum', 'abhol-datum'), (), 'any')}) p join ({rule(0, ('auftragsdatum',), (), 'any')}) o on p.doc_id = o.doc_id where p.d is null"
    source = "case k when -1 then 'auftragsdatum' " + " ".join(f"when {k} then '{n}'" for k, (n, *_) in enumerate(dates.PRIORITIES)) + " else 'fallback' end"
    return f"""with s as materialized (select *, lower(line) low from {SOLID}), f as materialized (select * from {_first('s')}), da as materialized (select * from {_first("(select * from s where contains(low, 'date'))", dates.PATTERNS[9:])}),
 af as materialized (select doc_id, idx, arg_min(d, k) d from ({after}) group by 1, 2), p as ({rules} union all {pickup} union all select 99 k, doc_id, arg_min(d, idx) d from f group by doc_id)
 select doc_id, arg_min(d, k) as date, arg_min({source}, k) source from p where d is not null group by doc_id"""


@query(_priority())
def d15_priority_dates(s, d):
    return dates.priority_dates(documents(s, d))


def _candidates(base: float) -> str:
    # the letter O between digits is a zero; without look-around each side is kept by hand, twice for neighbours
    clean = "regexp_replace(replace({0}, ',', '.'), '\\s+', ' ', 'g')"
    for p in ("(\\d)[oO](\\d)", "(\\d)[oO](\\d)", "(\\d)[oO]([./-])", "([./-])[oO](\\d)"):
        clean = f"regexp_replace({clean}, '{p}', '\\10\\2', 'g')"
    clean = f"trim({clean})"
    raw = "\\b\\d{1,2}[.\\-/]\\d{1,2}[.\\-/]\\d{2,4}\\b"
    rows = " union all ".join(f"select doc_id, line_no, low, {k} k, unnest(regexp_extract_all(t, '{p}')) raw from x" for k, p in enumerate((dates.PATTERNS[0][0], raw, dates.PATTERNS[9][0])))
    d = f"case k when 0 then {_read('raw', 'ymd')} when 1 then case when regexp_matches(raw, '[.\\-/]\\d{{2}}$') then {_read('raw', 'dmyy')} else {_read('raw', 'dmy')} end else {_read('raw', 'name')} end"
    label = "case " + " ".join(f"when regexp_matches(low, '{p}') then '{n}'" for n, p, _, _ in dates.LABELS) + f" when contains(low, 'vom') and {_has('low', ('lieferschein', 'beleg', 'bericht'))} then 'vom' else 'generic' end"
    prio = "case label " + " ".join(f"when '{n}' then {p}" for n, _, p, _ in dates.LABELS) + " else 99 end"
    bonus = "case label " + " ".join(f"when '{n}' then {b}" for n, _, _, b in dates.LABELS) + " when 'vom' then 0.05 else 0.0 end"
    return f"""with l as (select doc_id, line_no, line, {clean.format('line')} c from {LINES}), n as (select *, coalesce(lead(c) over (partition by doc_id order by line_no), '') nxt from l),
 x as (select doc_id, line_no, lower(line) low, trim(concat_ws(' ', c, nxt)) t from n where regexp_matches(line, '\\S') and not regexp_matches(lower(line), '{dates.EXCLUDED}')),
 y as (select *, {label} label from (select doc_id, line_no, low, raw, {d} d from ({rows})) where d is not null) select doc_id, line_no, d as date, raw, label, {prio} priority, round(least({base} + {bonus}, 0.99), 4)::double confidence from y"""


@query(_candidates(0.7))
def d13_line_dates(s, d):
    return dates.line_candidates(documents(s, d))


def _context(as_of: str) -> str:
    rows = []
    for k, p in enumerate(("\\b\\d{1,2}[.\\-/]\\d{1,2}[.\\-/]\\d{4}\\b", "\\b\\d{4}[.\\-/]\\d{1,2}[.\\-/]\\d{1,2}\\b")):
        total = lambda a, n: f"coalesce(list_sum(list_transform({a}[1:{n}], lambda z: length(z))), 0)"
        rows.append(f"select doc_id, {k} k, text, raws[i] raw, {total('gaps', 'i')} + {total('raws', 'i - 1')} pl from (select doc_id, text, raws, gaps, unnest(generate_series(1, len(raws))) i from (select doc_id, text, regexp_extract_all(text, '{p}') raws, string_split_regex(text, '{p}') gaps from documents where text is not null))")
    d = f"case k when 0 then {_read('raw', 'dmy')} else {_read('raw', 'ymd')} end"
    label = "case " + " ".join(f"when {_has('c', words)} then '{n}'" for n, words in dates.CONTEXT) + " end"
    return f"""with h as (select doc_id, k, cast(pl as integer) pl, {d} d, lower(substr(text, cast(greatest(pl - 50, 0) as integer) + 1, cast(pl + length(raw) + 50 - greatest(pl - 50, 0) as integer))) c from ({" union all ".join(rows)})),
 x as (select doc_id, k, pl, d, {label} label, date_diff('day', date '{as_of}', d) nd from h where d is not null),
 y as (select *, round(least(0.5 + case when nd between -730 and 30 then 0.3 else -0.5 end + case when label is not null then 0.3 else 0 end + case when label = 'Rechnungsdatum' then 0.2 else 0 end + case when abs(nd) <= 30 then 0.1 when abs(nd) <= 90 then 0.05 else 0 end, 1.0), 4)::double confidence from x)
 select doc_id, cast(r as integer) as rank, d as date, label, confidence from (select *, row_number() over (partition by doc_id order by confidence desc, k, pl) r from y where confidence >= 0.3) where r <= 5"""


@query(_context("2024-06-01"))
def d18_context_dates(s, d):
    return dates.context_dates(documents(s, d), "2024-06-01")


# --- types


def _types(source: str, key: str, lines: str) -> str:
    """source: a table with (key, text, supplier); the words are a table that each segment is tested against."""
    T = doctypes
    norm = lambda c: "regexp_replace(regexp_replace(replace(replace(replace(replace(lower(" + c + "),'ä','ae'),'ö','oe'),'ü','ue'),'ß','ss'), '[_:/\\\\-]+', ' ', 'g'), '\\s+', ' ', 'g')"
    rows, o = [], 0
    for k, t in enumerate(T.TYPES):
        for lists, segs in ([(((T.TITLE, 0.45),), T.WEIGHTS[:1])] if t == T.RE else []) + [(T.WORDS[t], T.WEIGHTS)]:
            for seg, w in segs:
                for words, add in lists:
                    for x in words:
                        rows.append(f"({k},{o},'{seg}','{x}','{plain_classifier_text(x)}',{add}::double * {w}::double)")
                        o += 1
    any_of = lambda c, words: "(" + " or ".join(f"contains({c}, '{plain_classifier_text(w)}')" for w in words) + ")"
    count = lambda c, words: "(" + " + ".join(f"contains({c}, '{plain_classifier_text(w) if w.strip() == w else w}')::int" for w in words) + ")"
    pts = lambda k: f"coalesce(sum(p) filter (where k = {k}), 0)"
    names = ("re", "ls", "ue", "ko", "pr")
    ev = lambda k: f"list_aggregate(list_transform(list_filter(ev, lambda h: h.k = {k})[1:5], lambda h: h.e), 'string_agg', '|')"
    chosen_ev = "case chosen " + " ".join(f"when '{t}' then {ev(k)}" for k, t in enumerate(T.TYPES)) + " end"
    return f"""with kw(k, o, seg, w, n, p) as (values {",".join(rows)}), d as (select {key} doc_id, text, supplier from {source} where text is not null),
 g as (select d.doc_id, supplier, {norm("text")} whole, coalesce({norm("hd")}, '') header, coalesce({norm("bd")}, '') body, coalesce({norm("ft")}, '') footer from d left join
 (select doc_id, string_agg(line, chr(10) order by line_no) filter (where line_no < 35) hd, string_agg(line, chr(10) order by line_no) filter (where line_no >= 35 and line_no < n - 35) bd, string_agg(line, chr(10) order by line_no) filter (where line_no >= n - 35) ft from {lines} group by 1) s on d.doc_id = s.doc_id),
 t as (select *, header || ' ' || body both_, contains(header, 'rechnung') or contains(header, 'invoice') title from g),
 r as (select *, {count("both_", T.REPORT_MARKS)} >= 2 or ({count("both_", T.REPORT_MARKS)} >= 1 and {count("both_", T.REPORT_CONTEXT)} >= 2) report from t),
 h as (select r.doc_id, kw.* from r join kw on contains(case kw.seg when 'header' then header when 'body' then body else footer end, kw.n) and (kw.k <> 0 or title)),
 p as (select doc_id, {", ".join(f"{pts(k)} {n}" for k, n in enumerate(names))}, list({{'k': k, 'e': w || '@' || seg}} order by o) ev from h group by 1),
 s as (select r.*, round(coalesce(re, 0) - 0.15 * {count("whole", T.NEGATIVE)} + case when supplier = 'Manitowoc' then 0.10 else 0 end, 6)::double re, round(coalesce(ls, 0), 6)::double ls, round(coalesce(ue, 0), 6)::double ue, round(coalesce(ko, 0), 6)::double ko,
 round(coalesce(pr, 0) + case when report then 0.45 else 0 end + case when supplier = 'Dekra' then 0.30 else 0 end, 6)::double pr, ev from r left join p on r.doc_id = p.doc_id),
 b as (select *, list_reverse_sort([re, ls, ue, ko, pr]) srt, list_position([re, ls, ue, ko, pr], greatest(re, ls, ue, ko, pr)) bi from s),
 c as (select *, bi <> 2 and {any_of("header", T.LS_STRONG)} and not title delivery from b),
 e as (select *, case when delivery then 'LIEFERSCHEIN' else list_extract([{",".join(f"'{t}'" for t in T.TYPES)}], bi) end chosen,
 least(0.99, 0.55 + least(case when delivery then ls else srt[1] end, 1.0) * 0.35 + greatest(0.0, case when delivery then ls - srt[1] else srt[1] - srt[2] end) * 0.25) sure,
 case when upper(trim(supplier)) in ('WM','WM SE','WMSE') then 'always' when {any_of("both_", T.UE_STRONG)} then 'takeover' when report and pr > 0 then 'report' when srt[1] <= 0 then 'none' else 'best' end kind from c)
 select doc_id, case kind when 'always' then 'LIEFERSCHEIN' when 'takeover' then 'ÜBERNAHMESCHEIN' when 'report' then 'PRÜFBERICHT' when 'none' then 'SONSTIGES' else case when round(sure, 6) < 0.60 then 'SONSTIGES' else chosen end end doc_type,
 round(case kind when 'always' then 0.99 when 'takeover' then least(0.99, 0.88 + least(ue, 1.0) * 0.10) when 'report' then least(0.99, 0.82 + least(pr, 1.0) * 0.12) when 'none' then 0.5 else sure end, 4)::double confidence,
 coalesce(case kind when 'always' then 'supplier_hint' when 'takeover' then {ev(2)} when 'report' then coalesce({ev(4)}, 'report_pattern') when 'none' then 'no_words' else {chosen_ev} end, '') evidence,
 {", ".join(f"round({n}, 4) {n}" for n in names)} from e"""


@query(_types("(select *, null::varchar supplier from documents)", "doc_id", LINES))
def d30_document_types(s, d):
    return doctypes.classify(documents(s, d).withColumn("supplier", F.lit(None).cast("string")))


_LABELLED = LINES.replace("from documents where", f"from (select label_id doc_id, text from {L}) where")


@query(_types(f"(select label_id, text, case when label_id % 3 = 0 then 'Dekra' when label_id % 3 = 1 then 'Manitowoc' else supplier end supplier from {L})", "label_id", _LABELLED))
def d31_supplier_hints(s, d):
    """The same with suppliers that hint at a type; every third label stands for each of them, as the test names hint at none."""
    t = once(s, d, "labeled_documents", "label_id")
    hint = F.when(F.col("label_id") % 3 == 0, "Dekra").when(F.col("label_id") % 3 == 1, "Manitowoc").otherwise(F.col("supplier"))
    return doctypes.classify(t.select(F.col("label_id").alias("doc_id"), "text", hint.alias("supplier")))


# --- numbers

SUPPLIER_FIELDS = {
    "FUCHS": numbers.Fields(("Lieferschein", "Nummer"), ("Auftragsnummer",)),
    "Muster": numbers.Fields(("Beleg-Nr", "Rechnung"), ("Vorgang", "Nr."), {"Rechnung": (("Rechnung Nr", "Nr."), ("Nummer",))}),
}
KINDS = ("Rechnung", "Lieferschein")


def _numbers(source: str, lines: str, suppliers, kinds) -> str:
    N = numbers
    rows = ",".join("(" + ",".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in N.plans(None, suppliers, kinds))
    ok = lambda t: f"length({t}) >= 4 and not regexp_matches({t}, '{N.DATE}') and not regexp_matches({t}, '{N.IBAN}') and not (regexp_matches({t}, '[ ()/\\-]') and regexp_matches({t}, '{N.PHONE}')) and not regexp_matches({t}, '{N.AMOUNT}') and regexp_matches({t}, '\\d')"
    first = lambda c: f"list_filter(list_concat(regexp_extract_all({c}, '{N.TOKENS[0]}'), regexp_extract_all({c}, '{N.TOKENS[1]}')), lambda t: {ok('t')})[1]"
    total = lambda a, n: f"coalesce(list_sum(list_transform({a}[1:{n}], lambda z: length(z))), 0)"
    place = " union all ".join(f"select v, raws[i] t, {total('gaps', 'i')} + {total('raws', 'i - 1')} p from (select v, raws, gaps, unnest(generate_series(1, len(raws))) i from (select v, regexp_extract_all(v, '{p}') raws, string_split_regex(v, '{p}') gaps from v))" for p in N.TOKENS)
    known = ",".join(f"'{k.upper()}'" for k in ("", *kinds))
    return f"""with f(s, d, tier, ord, name, pattern, conf) as (values {rows}), b as (select doc_id, coalesce(supplier, '') supplier, case when upper(coalesce(doc_type, '')) in ({known}) then upper(coalesce(doc_type, '')) else '' end doc_type from {source}),
 l as (select doc_id, line_no, line, coalesce(lead(line) over w, '') n1, coalesce(lead(line, 2) over w, '') n2 from {lines} window w as (partition by doc_id order by line_no)),
 m as materialized (select l.*, f.*, instr(lower(line), lower(name)) - 1 pos from l join b on l.doc_id = b.doc_id join f on upper(f.d) = b.doc_type and f.s in ('', b.supplier) where regexp_matches(line, '(?i)' || pattern)),
 vp as (select distinct n1 v, pos from m union select distinct n2, pos from m), v as (select distinct v from vp), placed as materialized (select distinct * from ({place}) where {ok('t')}),
 u as (select v, pos, case when count(*) >= 2 and min_by(p + greatest(length(t), 1), row(abs(p - pos), p, t)) >= pos then min_by(t, row(abs(p - pos), p, t)) end under from vp join placed using (v) where pos >= 0 group by v, pos),
 q as (select m.*, regexp_replace(lower(name), '([^a-z0-9\\s])', '\\\\\\1', 'g') nm, regexp_replace(substr(line, length(regexp_extract(line, '(?is)^.*?' || pattern)) + 1), '^[: \\t]+', '') tail, coalesce(u1.under, u2.under) under from m left join u u1 on u1.v = n1 and u1.pos = m.pos left join u u2 on u2.v = n2 and u2.pos = m.pos),
 z as (select *, coalesce(under, case when not regexp_matches(lower(line), 'datum[:\\s-]*' || nm || '|' || nm || '[:\\s-]*datum') then coalesce({first('tail')}, {first('n1')}, {first('n2')}) end) number from q)
 select doc_id, arg_min(number, k) number, arg_min(name, k) field, arg_min(conf, k) confidence from (select *, row(tier, ord, line_no) k from z where number is not null) group by doc_id"""


@query(_numbers("(select doc_id, null::varchar supplier, null::varchar doc_type from documents)", LINES, {}, ()))
def d40_document_numbers(s, d):
    none = F.lit(None).cast("string")
    return numbers.document_numbers(documents(s, d).withColumn("supplier", none).withColumn("doc_type", none))


@query(_numbers(f"(select label_id doc_id, case label_id % 3 when 0 then 'FUCHS' when 1 then 'Muster' end supplier, document_type doc_type from {L})", _LABELLED, SUPPLIER_FIELDS, KINDS))
def d41_supplier_numbers(s, d):
    """Every third label stands for each supplier that has field names of its own, as the test tables name none."""
    t = once(s, d, "labeled_documents", "label_id")
    who = F.when(F.col("label_id") % 3 == 0, "FUCHS").when(F.col("label_id") % 3 == 1, "Muster")
    return numbers.document_numbers(t.select(F.col("label_id").alias("doc_id"), "text", who.alias("supplier"), F.col("document_type").alias("doc_type")), SUPPLIER_FIELDS, KINDS)


def _plates() -> str:
    N = numbers
    start = lambda p: p.replace("\\b(", "(?:^|[^\\pL\\pN_])(", 1)  # noqa: E731 letters with accents are letters
    part = lambda p, k: f"upper(regexp_extract(line, '{p}', {k}))"
    plain = lambda c: f"replace(replace(replace({c},'Ä','AE'),'Ö','OE'),'Ü','UE')"
    one = lambda p: f"case when {part(p, 3)} <> '' and {part(p, 1)} || {part(p, 2)} <> 'VOM' and not regexp_matches(upper(line), 'GMBH|GMB ?- ?H') and {part(p, 1)} not in ('GMB','GMBH') then {plain(part(p, 1))} || '-' || {plain(part(p, 2))} || {part(p, 3)} end"
    return f"""with p as (select doc_id, line_no, line, {one(start(N.PLATE))} p, {one(start(N.MERGED))} m from (select doc_id, line_no, trim(line) line from {LINES})), w as (select *, lead(p) over (partition by doc_id order by line_no) nx from p),
 t as (select doc_id, 1 tier, line_no, coalesce(p, nx) v from w where line_no < 80 and regexp_matches(line, '{N.NAMED}') union all select doc_id, 2, line_no, p from w union all select doc_id, 3, line_no, coalesce(p, m) from w)
 select doc_id, arg_min(v, row(tier, line_no)) plate, min(tier) tier from t where v is not null group by doc_id"""


@query(_plates())
def f35_plates(s, d):
    return numbers.plates(documents(s, d))


# --- suppliers


_FORM = "\\s+(GmbH & Co\\. KG|GmbH|KG|OHG|AG|SE|e\\.K\\.)$"


def _supplier_dims(s, d):
    r = table(s, d, "supplier_ref")
    bare = F.regexp_replace("ref_name", _FORM, "")
    aliases = r.select((F.col("ref_id") * 10).alias("ord"), F.col("ref_name").alias("canonical"), F.explode(F.array("ref_name", bare)).alias("alias")).select((F.col("ord") + (F.col("alias") != F.col("canonical")).cast("int")).alias("ord"), "canonical", "alias").distinct()
    first = F.substring_index("ref_name", " ", 1)
    patterns = r.where("ref_id % 7 = 0").select(F.col("ref_id").alias("ord"), F.col("ref_name").alias("canonical"), F.concat(F.lit("(?i)^"), first).alias("pattern"))
    contexts = r.select(F.col("ref_id").alias("ord"), F.col("ref_name").alias("canonical"), first.alias("trigger"), F.col("city").alias("word"))
    return aliases, patterns, contexts


_KEY = KEY.format
_CANON = f"""with r as (select ref_id, ref_name, city, split_part(ref_name, ' ', 1) w from supplier_ref), a as (select distinct ref_id * 10 + (alias <> canonical)::int ord, canonical, alias from (select ref_id, ref_name canonical, unnest([ref_name, regexp_replace(ref_name, '{_FORM}', '')]) alias from r)),
 n as (select match_id, canonical_name raw, lower(canonical_name) low, {_KEY('canonical_name')} k, lower(canonical_name || ' ' || coalesce(matched_alias, '')) txt from {M} where trim(canonical_name) <> ''),
 e as (select match_id, arg_min(canonical, ord) canonical, arg_min(alias, ord) matched, arg_min(eq, ord) eq from (select n.match_id, a.*, (lower(alias) = low or (k <> '' and {_KEY('alias')} = k)) eq from n join a on lower(alias) = low or (k <> '' and {_KEY('alias')} = k)
   or ((contains(low, lower(alias)) or contains(lower(alias), low)) and least(length(alias), length(low)) >= 0.7 * greatest(length(alias), length(low)))) group by 1),
 p as (select match_id, arg_min(ref_name, ref_id) canonical, arg_min(regexp_extract(raw, '(?i)^' || w), ref_id) matched from n join r on ref_id % 7 = 0 and regexp_matches(raw, '(?i)^' || w) group by 1),
 c as (select match_id, arg_min(ref_name, ref_id) canonical, arg_min(w, ref_id) matched from n join r on contains(low, lower(w)) and contains(txt, lower(city)) group by 1)
 select match_id rec_id, coalesce(e.canonical, p.canonical, c.canonical) canonical, case when e.canonical is not null then case when eq then 0.95 else 0.85 end when p.canonical is not null then 0.90 else 0.75 end::double confidence, coalesce(e.matched, p.matched, c.matched) matched,
 case when e.canonical is not null then case when eq then 'exact' else 'substring' end when p.canonical is not null then 'regex' else 'context' end match_type from n left join e using (match_id) left join p using (match_id) left join c using (match_id) where coalesce(e.canonical, p.canonical, c.canonical) is not null"""


@query(_CANON)
def d23_canonical_suppliers(s, d):
    m = once(s, d, "supplier_matches", "match_id")
    n = m.select(F.col("match_id").alias("rec_id"), F.col("canonical_name").alias("raw"), F.concat_ws(" ", "canonical_name", "matched_alias").alias("full_text"))
    return suppliers.canonicalise(n, *_supplier_dims(s, d))


def _prints() -> str:
    plain = lambda c: f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    fold = lambda c: f"translate({c}, '0l15348', 'oiiseab')"
    words = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda w: length(w) >= 3))"
    grams = lambda c: f"list_sort(list_distinct(list_transform(generate_series(1, length(replace({c}, ' ', '')) - 2), lambda i: substr(replace({c}, ' ', ''), i::integer, 3))))[1:10]"
    return f"""with r as (select ref_id name_id, lower(ref_name) low, {plain('ref_name')} n, {plain('ref_code')} a from supplier_ref), k as (select *, list_distinct(list_concat({words('n')}, {words('a')})) w, {grams('n')} g, {fold('n')} f from r),
 d as (select doc_id, {plain('text')} t from documents where text is not null), e as (select *, {words('t')} w, case when length(replace(t, ' ', '')) >= 3 then {grams('t')} else [] end g, {fold('t')} f from d),
 s as (select doc_id, name_id, contains(t, low)::int * 1.0::double + contains(t, a)::int * 0.95::double + contains(e.f, k.f)::int * 0.8::double + 0.7::double * len(list_intersect(e.w, k.w)) / len(k.w) + case when len(list_intersect(e.g, k.g)) > 0.3 * len(list_distinct(list_concat(e.g, k.g))) then 0.5::double * len(list_intersect(e.g, k.g)) / len(list_distinct(list_concat(e.g, k.g))) else 0 end s from e, k),
 o as (select *, round(s, 9) v, row_number() over (partition by doc_id order by round(s, 9) desc, name_id) rk, max(round(s, 9)) over (partition by doc_id) mx from s where s > 0) select doc_id, cast(rk as integer) as rank, name_id, round(least(v / greatest(1.0, mx), 1.0), 6)::double score from o where rk <= 3"""


@query(_prints())
def d25_fingerprints(s, d):
    r = table(s, d, "supplier_ref").select(F.col("ref_id").alias("name_id"), F.col("ref_name").alias("name"), F.array("ref_code").alias("aliases"))
    return suppliers.fingerprints(documents(s, d), r)


@query(f"select match_id, canonical_name from {M} m where canonical_name is not null and not exists (select 1 from supplier_ref r where r.ref_id % 48 = 0 and contains({_KEY('m.canonical_name')}, {_KEY('r.city')}))")
def j05_not_blocked(s, d):
    m = once(s, d, "supplier_matches", "match_id").where("canonical_name is not null").select("match_id", "canonical_name")
    return suppliers.without_blocked(m, table(s, d, "supplier_ref").where("ref_id % 48 = 0").select(F.col("city").alias("word")).distinct(), "canonical_name")
