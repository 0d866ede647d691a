"""Named queries of kept rows and small surfaces: deletes, undo, lists, lookups, replies, tables; and SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import keep, vectors
from paperloom.plans.catalog import COS, KEY, L, LINES, M, Q, S, U, documents, once, query
from paperloom.session import table

QUARTER = "upload_id % 4 = 0"


@query(f"select upload_id, case when upload_id % 4 = 0 and batch_no >= 5 then 'READY' else 'NEW' end status, owner_scope from {U}")
def j21_bulk_status(s, d):
    u = once(s, d, "uploads", "upload_id").withColumn("status", F.lit("NEW"))
    return keep.bulk_update(u, u.where(f"{QUARTER} and batch_no >= 5"), "upload_id", "status", F.lit("READY"))[0].select("upload_id", "status", "owner_scope")


@query(f"select id upload_id, id in (select upload_id from {U}) done from (select upload_id + 3 * (upload_id % 2) * 100000 id from {U} where upload_id % 4 < 2)")
def j21_bulk_report(s, d):
    u = once(s, d, "uploads", "upload_id")
    ids = u.where("upload_id % 4 < 2").select(F.expr("upload_id + 3 * (upload_id % 2) * 100000").alias("upload_id"))
    return keep.bulk_update(u, ids, "upload_id", "file_id", F.lit("x"))[1]


@query(f"select upload_id, file_id from {U} where not (coalesce(batch_no, 0) = 3)")
def u13_bulk_delete(s, d):
    u = once(s, d, "uploads", "upload_id")
    return keep.bulk_delete(u, u.where("batch_no = 3"), "upload_id").select("upload_id", "file_id")


@query(f"select entry_id, owner_scope from {Q} where trim(coalesce(owner_scope, '')) = '' or owner_scope = (select min(owner_scope) from sites)")
def p24_visible(s, d):
    one = table(s, d, "sites").agg(F.min("owner_scope").alias("o")).first().o
    return keep.visible(once(s, d, "quarantine", "entry_id"), "owner_scope", one).select("entry_id", "owner_scope")


_EVENTS = f"(select entry_id, case entry_id % 5 when 0 then 'delete' when 1 then 'restore' when 2 then 'purge' else 'delete' end kind, quarantined_at at_ from {Q} where entry_id % 3 = 0)"


@query(f"select q.entry_id, case when e.kind is null or e.kind = 'restore' then 'live' when e.kind = 'purge' then 'gone' when e.at_ >= timestamp '2024-06-01' - interval 200 day then 'trash' else 'gone' end state from {Q} q left join {_EVENTS} e using (entry_id)")
def u14_trash(s, d):
    q = once(s, d, "quarantine", "entry_id")
    kind = F.when(F.col("entry_id") % 5 == 1, "restore").when(F.col("entry_id") % 5 == 2, "purge").otherwise("delete")
    e = q.where("entry_id % 3 = 0").select("entry_id", kind.alias("kind"), F.col("quarantined_at").alias("at"))
    return keep.trash(q.select("entry_id"), "entry_id", e, "2024-06-01", 200).select("entry_id", "state")


@query(f"select owner_scope, 'undo' kind, arg_max(coalesce(corrected_supplier, ''), row(quarantined_at, entry_id)) as before, arg_max(coalesce(supplier, ''), row(quarantined_at, entry_id)) as after from {Q} where quarantined_at is not null and coalesce(reviewed, false) group by owner_scope")
def u17_undo(s, d):
    q = once(s, d, "quarantine", "entry_id").where("quarantined_at is not null")
    e = q.select("owner_scope", F.coalesce("supplier", F.lit("")).alias("before"), F.coalesce("corrected_supplier", F.lit("")).alias("after"), F.when(F.coalesce("reviewed", F.lit(False)), "change").otherwise("undo").alias("kind"), "quarantined_at", "entry_id")
    return keep.undo_last(e, "owner_scope", ["quarantined_at", "entry_id"])


@query("select owner_scope as scope, coalesce(case when substr(zone_name, 1, 1) = 'E' then locale end, 'de') lang, case when length(zone_name) % 2 = 0 then length(zone_name) else 20 end::bigint page, true compact from sites")
def u18_preferences(s, d):
    st = table(s, d, "sites")
    page = F.when(F.length("zone_name") % 2 == 0, F.length("zone_name").cast("string")).otherwise(F.lit('"many"'))
    prefs = F.concat(F.lit('{"page": '), page, F.lit(', "compact": "perhaps"'), F.when(F.col("zone_name").startswith("E"), F.concat(F.lit(', "lang": "'), "locale", F.lit('"'))).otherwise(""), F.lit("}"))
    return keep.preferences(st.select(F.col("owner_scope").alias("scope"), prefs.alias("prefs")), {"lang": "de", "page": 20, "compact": True})


@query(f"select min(name) as name from (select name, lower(trim(name)) k from {S} where supplier_id % 2 = 1 and name is not null) where k not in (select lower(trim(name)) from {S} where supplier_id % 2 = 0 and name is not null) group by k")
def u22_insert_if_absent(s, d):
    n = once(s, d, "suppliers", "supplier_id")
    norm = lambda c: F.lower(F.trim(c))
    return keep.insert_if_absent(n.where("supplier_id % 2 = 0").select("name"), n.where("supplier_id % 2 = 1").select("name"), "name", norm)


@query(f"select upload_id, case when trim(original_name) <> '' then 'out:' || trim(original_name) when trim(file_id) <> '' then 'path:' || trim(file_id) when trim(sha256) <> '' then 'original:' || trim(sha256) else 'row:' || upload_id end k from {U}")
def u02_merge_keys(s, d):
    u = once(s, d, "uploads", "upload_id")
    return u.select("upload_id", keep.result_key(F.col("original_name"), F.col("file_id"), F.col("sha256"), F.col("upload_id")).alias("k"))


@query(f"select label_id, supplier from {L} order by supplier asc nulls last, label_id limit 50")
def w06_sorted_results(s, d):
    t = once(s, d, "labeled_documents", "label_id")
    return keep.sorted_results(t, "supplier_asc", {"supplier": "supplier", "file": "filename", "date": "labeled_at"}, "label_id", 50).select("label_id", "supplier")


@query(f"with p as (select k, arg_max(t, name) t, arg_max(least_, name) least_ from (select {KEY.format('ref_name')} k, ref_name as name, case when ref_id % 2 = 0 then 'RECHNUNG' end t, 0.9::double least_ from supplier_ref) where k <> '' group by k) select match_id, coalesce(p.t, m.match_type) doc_type, coalesce(p.least_, 0.85)::double as least, p.k is not null profiled from {M} m left join p on {KEY.format('m.canonical_name')} = p.k")
def j08_profiles(s, d):
    m = once(s, d, "supplier_matches", "match_id").select("match_id", "canonical_name", F.col("match_type").alias("doc_type"))
    p = table(s, d, "supplier_ref").select(F.col("ref_name").alias("name"), F.when(F.col("ref_id") % 2 == 0, "RECHNUNG").alias("doc_type"), F.lit(0.9).alias("least"))
    return keep.enrich(m, p, "canonical_name", X.supplier_key).select("match_id", "doc_type", "least", "profiled")


_CELLS = f"(select doc_id, 0 table_no, line_no row_no, unnest(generate_series(0, len(c) - 1)) col_no, unnest(c) cell from (select doc_id, line_no, regexp_split_to_array(line, ' {{2,}}') c from {LINES} where regexp_matches(line, '^ +\\d+ {{2,}}')))"


@query(f"with r as (select doc_id, row_no, string_agg(trim(regexp_replace(cell, '\\s+', ' ', 'g')), ' | ' order by col_no) t, bool_or(trim(cell) <> '') solid from {_CELLS} group by 1, 2), k as (select *, row_number() over (partition by doc_id order by row_no) rk from r where solid) select doc_id, 0 table_no, count(*) n_rows, string_agg(t, chr(10) order by row_no) filter (where rk <= 10) as text from k group by doc_id")
def a28_table_summary(s, d):
    from paperloom.operators.extract import lines

    x = lines(documents(s, d)).where(F.col("line").rlike(r"^ +\d+ {2,}"))
    c = x.select("doc_id", F.lit(0).alias("table_no"), F.col("line_no").alias("row_no"), F.posexplode(F.split("line", " {2,}")).alias("col_no", "cell"))
    return keep.table_summary(c)


_REPLY = "case label_id % 4 when 0 then 'Here it is:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' when 1 then j when 2 then 'no object here' else '{\"supplier\": broken' end"


@query(f"with t as (select label_id, supplier, document_type, date, label_id % 4 in (0, 1) ok from {L}) select label_id, case when ok then nullif(trim(regexp_replace(supplier, '\\s+', ' ', 'g')), '') end supplier, case when ok then upper(nullif(trim(document_type), '')) end doc_type, case when not ok then 'no_json' end error from t")
def f92_suggestions(s, d):
    t = once(s, d, "labeled_documents", "label_id")
    j = F.to_json(F.struct("supplier", F.col("document_type").alias("doc_type"), "date"))
    fenced = F.concat(F.lit("Here it is:\n```json\n"), j, F.lit("\n```"))
    k = F.col("label_id") % 4
    reply = F.when(k == 0, fenced).when(k == 1, j).when(k == 2, "no object here").otherwise('{"supplier": broken')
    return t.select("label_id", keep.suggestion(reply).alias("s")).select("label_id", "s.supplier", "s.doc_type", "s.error")


@query(r"""with p as (select doc_id, list_transform(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''), lambda s: len(list_filter(regexp_split_to_array(s, '[ \t\n\x0b\f\r]+'), lambda w: w <> ''))) n from documents where text is not null),
 c as (select doc_id, list_reduce(list_transform(n, lambda x: [x]), lambda a, x: case when a[-1] = 0 or a[-1] + x[1] <= 60 then list_concat(a[:-2], [a[-1] + x[1]]) else list_concat(a, x) end) c from p where len(n) > 0)
 select doc_id, cast(i - 1 as integer) chunk_no, cast(c[i] as integer) n_words from (select doc_id, c, unnest(generate_series(1, len(c))) i from c) where c[i] > 0""")
def f43_sentence_chunks(s, d):
    x = documents(s, d).where("text is not null").select("doc_id", F.posexplode(keep.sentence_chunks(F.col("text"), 60)).alias("chunk_no", "n_words"))
    return x.where("n_words > 0")


@query()
def j09_negatives(s, d):
    t = once(s, d, "labeled_documents", "label_id").where("supplier is not null and filename is not null")
    return keep.negatives(t.select(F.concat("filename", F.lit("#"), "label_id").alias("path"), "supplier"), 3, 42)


@query(f"select entry_id, document_path, doctype_confidence from {Q} where not coalesce(reviewed, false) and (supplier_confidence < 0.6 or date_confidence < 0.6) order by doctype_confidence asc nulls first, entry_id limit 100")
def w10_worklist(s, d):
    q = once(s, d, "quarantine", "entry_id").where("not coalesce(reviewed, false) and (supplier_confidence < 0.6 or date_confidence < 0.6)")
    return q.orderBy(F.asc_nulls_first("doctype_confidence"), "entry_id").limit(100).select("entry_id", "document_path", "doctype_confidence")


@query(f"select supplier_id, name from {S} where name is not null order by lower(name), supplier_id limit 100")
def w30_by_name(s, d):
    return once(s, d, "suppliers", "supplier_id").where("name is not null").orderBy(F.lower("name"), "supplier_id").limit(100).select("supplier_id", "name")


_KW = "rechnung|lieferschein|datum|invoice|beleg"


@query(f"select doc_id, cast(rk as integer) as rank, line_no, line from (select *, row_number() over (partition by doc_id order by line_no) rk from {LINES} where regexp_matches(lower(line), '{_KW}') or regexp_matches(line, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}')) where rk <= 20")
def p34_keyword_lines(s, d):
    from paperloom.operators.extract import line_array

    z = F.transform(line_array(F.col("text")), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    hit = F.slice(F.filter(z, lambda v: F.lower(v["line"]).rlike(_KW) | v["line"].rlike(r"\d{1,2}\.\d{1,2}\.\d{4}")), 1, 20)
    return documents(s, d).where("text is not null").select("doc_id", F.posexplode(hit).alias("rank", "v")).select("doc_id", (F.col("rank") + 1).alias("rank"), "v.line_no", "v.line")


_MISS = "(supplier is null or trim(supplier) in ('', '-', 'Unbekannt'))"
_NODATE = "(date is null or trim(date) in ('', '-') or contains(lower(date), 'unbekannt'))"


@query(f"select entry_id from {Q} where {_MISS} or {_NODATE} or coalesce(supplier_confidence, 0) < 0.85")
def p04_incomplete(s, d):
    return once(s, d, "quarantine", "entry_id").where(f"{_MISS} or {_NODATE} or coalesce(supplier_confidence, 0) < 0.85").select("entry_id")


@query(f"select entry_id, document_type from {Q} where not coalesce(reviewed, false) and document_type in ('RECHNUNG', 'LIEFERSCHEIN')")
def p08_review_queue(s, d):
    q = once(s, d, "quarantine", "entry_id")
    return q.where(~F.coalesce("reviewed", F.lit(False)) & F.col("document_type").isin("RECHNUNG", "LIEFERSCHEIN")).select("entry_id", "document_type")


@query("select candidate_id, doc_id, confidence from (select distinct on (candidate_id) * from date_candidates) where confidence >= 0.6")
def p35_confident_candidates(s, d):
    return once(s, d, "date_candidates", "candidate_id").where("confidence >= 0.6").select("candidate_id", "doc_id", "confidence")


@query(f"select upload_id, case when upload_id % 5 = 0 then upper(file_id) else original_name end original_name from {U}")
def u23_update_by_key(s, d):
    u = once(s, d, "uploads", "upload_id")
    c = u.where("upload_id % 5 = 0").select("upload_id", F.upper("file_id").alias("original_name"))
    return keep.update_from(u.select("upload_id", "original_name"), c, "upload_id", "original_name")


@query(f"select supplier_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '|') aliases from (select supplier_id, list_filter(aliases, lambda x: x is not null) a from {S} where aliases is not null)")
def u25_distinct_in_order(s, d):
    t = once(s, d, "suppliers", "supplier_id").where("aliases is not null")
    return t.select("supplier_id", F.array_join(F.array_distinct(F.array_compact("aliases")), "|").alias("aliases"))


@query(r"""with p as (select ocr_id, unnest(generate_series(1, len(p))) page, unnest(p) t from (select ocr_id, string_split(text, chr(12)) p from (select distinct on (ocr_id) * from ocr_results) where text is not null)),
 w as (select ocr_id, page, len(list_filter(regexp_split_to_array(t, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) w from p) select ocr_id, cast(arg_min(page, row(-w, page)) as integer) page, cast(max(w) as integer) words from w group by ocr_id""")
def w26_best_pages(s, d):
    return once(s, d, "ocr_results", "ocr_id").where("text is not null").select("ocr_id", keep.best_page(F.col("text")).alias("b")).select("ocr_id", "b.*")


@query(f"with r as (select file_id, owner_scope from {M} where match_id % 2 = 0) select distinct u.upload_id, u.file_id from {U} u join r on u.file_id = r.file_id and u.owner_scope = r.owner_scope")
def j15_owned_documents(s, d):
    r = once(s, d, "supplier_matches", "match_id").where("match_id % 2 = 0").select("file_id", "owner_scope").distinct()
    return once(s, d, "uploads", "upload_id").join(r, ["file_id", "owner_scope"], "left_semi").select("upload_id", "file_id")


@query(f"select query_id, vec_id, score, cast(k as integer) as rank from (select q.vec_id query_id, r.vec_id, {COS} score, row_number() over (partition by q.vec_id order by {COS} desc, r.vec_id) k from embeddings q, embeddings r where q.vec_id % 50 = 0 and q.vec_id <> r.vec_id and r.label = 1) where k <= 5")
def p25_filtered_nearest(s, d):
    e = table(s, d, "embeddings")
    return vectors.top_k(e.where("vec_id % 50 = 0"), e.where("label = 1"), 5)
