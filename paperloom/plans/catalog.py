"""Named queries of the core operators, and SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import extract, report, store, vectors
from paperloom.operators.timestamps import normalise_timestamps, reading_counts
from paperloom.session import spread, table
from paperloom.sources import readers
from paperloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def once(s: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """A log table with its repeated rows counted once."""
    return table(s, d, name).dropDuplicates([key])


def documents(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents"))


U = "(select distinct on (upload_id) * from uploads)"
Q = "(select distinct on (entry_id) * from quarantine)"
M = "(select distinct on (match_id) * from supplier_matches)"
S = "(select distinct on (supplier_id) * from suppliers)"
O = "(select distinct on (ocr_id) * from ocr_results)"
L = "(select distinct on (label_id) * from labeled_documents)"
D = "(select distinct on (candidate_id) * from date_candidates)"
TR = "replace(replace(replace(replace(replace(replace(replace({0},'ä','ae'),'Ä','Ae'),'ö','oe'),'Ö','Oe'),'ü','ue'),'Ü','Ue'),'ß','ss')"
KEY = "trim(regexp_replace(replace(replace(replace(replace(lower({0}),'ä','ae'),'ö','oe'),'ü','ue'),'ß','ss'),'[^a-z0-9]+',' ','g'))"
SAFE = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + TR + ",'\\s+','_','g'),'[^A-Za-z0-9._-]+','_','g'),'_+','_','g'),'^[._-]+|[._-]+$','','g'),''),'Unbekannt')"
LINES = "(select doc_id, unnest(generate_series(0, len(a) - 1)) line_no, unnest(a) line, len(a) n from (select doc_id, case when a[-1] = '' then a[:-2] else a end a from (select doc_id, string_split(regexp_replace(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), chr(10)) a from documents where text is not null)))"


def p1_records(s, d):
    c = table(s, d, "date_candidates").select(F.lit("date_candidates").alias("rec_table"), F.col("candidate_id").alias("rec_id"), "owner_scope", F.col("date_str").alias("val"))
    m = table(s, d, "labeled_documents").select(F.lit("labeled_documents").alias("rec_table"), F.col("label_id").alias("rec_id"), "owner_scope", F.col("date").alias("val"))
    return c.unionByName(m)


@query()
def p1_found(s, d):
    return normalise_timestamps(p1_records(s, d), table(s, d, "sites"))


@query()
def p1_readings(s, d):
    return reading_counts(p1_records(s, d), table(s, d, "sites"))


# --- sources and names


@query(f"select upload_id, coalesce(lower(regexp_extract(original_name,'^([A-Za-z]+)[ _-]',1)),'') kind, try_cast(nullif(regexp_extract(original_name,'[ _-]([0-9]+)\\.',1),'') as bigint) number, coalesce(lower(regexp_extract(original_name,'\\.([A-Za-z]+)$',1)),'') ext from {U} where original_name is not null")
def s22_filename_parts(s, d):
    return once(s, d, "uploads", "upload_id").where("original_name is not null").select("upload_id", extract.name_from_file().alias("p")).select("upload_id", "p.*")


@query(f"""with p as (select upload_id, string_split(regexp_replace(regexp_replace(original_name,'^.*/',''),'\\.[^.]*$',''),'_') p, regexp_replace(regexp_replace(original_name,'^.*/',''),'\\.[^.]*$','') stem from {U} where original_name is not null),
 a as (select *, coalesce(list_position(list_transform(p, lambda x: regexp_full_match(x,'[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}')), true), 0) at_ from p)
 select upload_id, case when at_ > 0 then array_to_string(p[1:at_-1],'_') else stem end supplier, case when at_ > 0 then cast(try_strptime(p[at_],'%d-%m-%Y') as date) end as date, case when at_ > 0 and at_ < len(p) then array_to_string(p[at_+1:],'_') end number from a""")
def s22_stem_parts(s, d):
    return once(s, d, "uploads", "upload_id").where("original_name is not null").select("upload_id", readers.stem_parts(F.col("original_name")).alias("p")).select("upload_id", "p.*")


@query(f"select {KEY.format('name')} key, count(*) n from {S} where name is not null group by 1")
def f03_supplier_keys(s, d):
    return once(s, d, "suppliers", "supplier_id").where("name is not null").groupBy(X.supplier_key(F.col("name")).alias("key")).agg(F.count("*").alias("n"))


@query(f"select entry_id, {SAFE.format('supplier')} safe, case when length({SAFE.format('supplier')}) > 24 then substr({SAFE.format('supplier')},1,17) || '_' || substr(sha1({SAFE.format('supplier')}),1,6) else {SAFE.format('supplier')} end short from {Q}")
def f11_safe_names(s, d):
    safe = X.safe_filename(F.col("supplier"))
    return once(s, d, "quarantine", "entry_id").select("entry_id", safe.alias("safe"), X.cut_with_hash(safe, 24).alias("short"))


@query(f"""select label_id, case when length(x) > 60 then substr(x,1,53) || '_' || substr(sha1(x),1,6) else x end stem,
 coalesce(strftime(labeled_at,'%Y-%m'),'-') folder from (select label_id, labeled_at, concat_ws('_', {SAFE.format('supplier')}, strftime(labeled_at,'%Y-%m-%d'), nullif(regexp_replace(doc_id,'[^A-Za-z0-9-]+','','g'),'')) x from {L})""")
def f20_target_names(s, d):
    t = once(s, d, "labeled_documents", "label_id")
    return t.select("label_id", X.file_stem(F.col("supplier"), F.col("labeled_at"), F.col("doc_id"), 60).alias("stem"), F.coalesce(X.month_folder(F.col("labeled_at")), F.lit("-")).alias("folder"))


@query("select doc_id, cast(('0x' || substr(sha256(cast(doc_id as varchar)),1,8))::bigint % 100 as integer) bucket, 'ohneNr_' || upper(substr(sha1(text),1,6)) fallback from documents where text is not null")
def f51_canary(s, d):
    return documents(s, d).where("text is not null").select("doc_id", X.canary_bucket(F.col("doc_id").cast("string")).alias("bucket"), X.fallback_number(F.col("text")).alias("fallback"))


@query(r"""select doc_id, cast(2 * len(list_filter(regexp_split_to_array(t, '[ \t\r\n]+'), lambda w: w <> '')) + length(regexp_replace(t,'[^a-z0-9]','','g')) // 25
 + 60 * (len(string_split(t,'rechnung')) - 1 + len(string_split(t,'lieferschein')) - 1) + case when len(string_split(t,'datum')) + len(string_split(t,'vom ')) > 2 then 80 else 0 end
 + 180 * len(regexp_extract_all(t,'[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}')) as integer) score from (select doc_id, lower(coalesce(text,'')) t from documents)""")
def f50_text_scores(s, d):
    return documents(s, d).select("doc_id", X.text_score(F.col("text"), ("rechnung", "lieferschein"), ("datum", "vom ")).cast("int").alias("score"))


@query(r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') w from documents where text is not null),
 c as (select doc_id, list_reduce(list_transform(w, lambda x: [length(x)]), lambda a, x: case when a[-1] + 1 + x[1] <= 400 then list_concat(a[:-2], [a[-1] + 1 + x[1]]) else list_concat(a, x) end) n from w where len(w) > 0)
 select doc_id, cast(i - 1 as integer) chunk_no, cast(n[i] as integer) n_chars from (select doc_id, n, unnest(generate_series(1, len(n))) i from c)""")
def f42_chunks(s, d):
    c = documents(s, d).where("text is not null").select("doc_id", F.posexplode(X.word_chunks(F.col("text"), 400)).alias("chunk_no", "chunk"))
    return c.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"))


@query(f"""select match_id, round(case when len(u) = 0 then 0 else len(i) / len(u) end, 6) jaccard from (select match_id, list_distinct(list_concat(a,b)) u, list_intersect(a,b) i from
 (select match_id, case when length(x) >= 3 then list_distinct(list_transform(generate_series(1, length(x) - 2), lambda k: substr(x, k, 3))) else [] end a, case when length(y) >= 3 then list_distinct(list_transform(generate_series(1, length(y) - 2), lambda k: substr(y, k, 3))) else [] end b
 from (select match_id, {KEY.format('canonical_name')} x, {KEY.format('matched_alias')} y from {M} where canonical_name is not null and matched_alias is not null)))""")
def u09_trigram_overlap(s, d):
    m = once(s, d, "supplier_matches", "match_id").where("canonical_name is not null and matched_alias is not null")
    j = X.jaccard(X.trigrams(X.supplier_key(F.col("canonical_name"))), X.trigrams(X.supplier_key(F.col("matched_alias"))))
    return m.select("match_id", F.round(j, 6).alias("jaccard"))


# --- predicates and projections


MISS = "(supplier is null or trim(supplier) in ('','-','k.A.','n/a') or lower(supplier) like '%unbekannt%')"


@query(f"""select owner_scope, count(*) n, count(*) filter (where {MISS}) supplier_missing, count(*) filter (where date is null or date in ('','-') or lower(date) like '%unbekannt%') date_missing,
 count(*) filter (where length(supplier) > 60 or length(supplier) - length(replace(supplier,' ','')) >= 8) supplier_broken, count(*) filter (where supplier_confidence < 0.85) review from {Q} group by owner_scope""")
def p01_missing_flags(s, d):
    q = once(s, d, "quarantine", "entry_id")
    miss = F.col("supplier").isNull() | F.trim("supplier").isin("", "-", "k.A.", "n/a") | F.lower("supplier").contains("unbekannt")
    nodate = F.col("date").isNull() | F.col("date").isin("", "-") | F.lower("date").contains("unbekannt")
    broken = (F.length("supplier") > 60) | (F.length("supplier") - F.length(F.replace("supplier", F.lit(" "), F.lit(""))) >= 8)
    return q.groupBy("owner_scope").agg(F.count("*").alias("n"), F.count_if(miss).alias("supplier_missing"), F.count_if(nodate).alias("date_missing"), F.count_if(broken).alias("supplier_broken"), F.count_if(F.col("supplier_confidence") < 0.85).alias("review"))


@query(f"select label_id, document_type, labeled_at from {L} where lower(supplier) like '%gmbh%' and document_type in ('RECHNUNG','GUTSCHRIFT') and labeled_at >= timestamp '2023-06-01' and labeled_at < timestamp '2024-06-01'")
def p09_saved_search(s, d):
    t = once(s, d, "labeled_documents", "label_id")
    hit = F.contains(F.lower("supplier"), F.lit("gmbh")) & F.col("document_type").isin("RECHNUNG", "GUTSCHRIFT")
    when = (F.col("labeled_at") >= F.expr("timestamp_ntz'2023-06-01'")) & (F.col("labeled_at") < F.expr("timestamp_ntz'2024-06-01'"))
    return t.where(hit & when).select("label_id", "document_type", "labeled_at")


@query(f"""select ocr_id, (a < 3 or (n >= 8 and a < 0.3 * n and o > 0.4 * n)) gibberish from (select ocr_id, length(text) n, length(regexp_replace(text,'[^A-Za-z]','','g')) a, length(regexp_replace(text,'[A-Za-z0-9]','','g')) o from {O} where text is not null)""")
def p17_gibberish(s, d):
    o = once(s, d, "ocr_results", "ocr_id").where("text is not null")
    n, a, x = F.length("text"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")), F.length(F.regexp_replace("text", "[A-Za-z0-9]", ""))
    return o.select("ocr_id", ((a < 3) | ((n >= 8) & (a < 0.3 * n) & (x > 0.4 * n))).alias("gibberish"))


@query(f"select ocr_id, least(length(text) / 500.0, 1.0)::double coverage, (length(text) / 500.0 < 0.3) needs_ocr from {O} where length(text) > 50")
def f82_coverage(s, d):
    c = F.length("text") / 500
    return once(s, d, "ocr_results", "ocr_id").where("length(text) > 50").select("ocr_id", F.least(c, F.lit(1.0)).alias("coverage"), (c < 0.3).alias("needs_ocr"))


# --- document extraction


@query(f"select count(*) n_lines, cast(sum(length(line)) as bigint) n_chars, count(distinct doc_id) n_docs, max(line_no) last_line from {LINES}")
def x03_lines(s, d):
    return extract.lines(documents(s, d)).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.countDistinct("doc_id").alias("n_docs"), F.max("line_no").cast("long").alias("last_line"))


@query(f"select doc_id, count(*) filter (where line_no < 5) header, count(*) filter (where line_no >= 5 and line_no < n - 4) body, count(*) filter (where line_no >= n - 4) footer from {LINES} group by doc_id")
def d02_segments(s, d):
    g = extract.segments(documents(s, d), 5, 4)
    return g.groupBy("doc_id").agg(*[F.count_if(F.col("segment") == x).alias(x) for x in ("header", "body", "footer")])


@query(f"with n as (select ref_id, {KEY.format('ref_name')} k from supplier_ref), t as (select doc_id, {KEY.format('text')} t from documents where text is not null) select doc_id, min(ref_id) name_id, count(*) n_found from t join n on contains(t, k) group by doc_id")
def j01_contained_suppliers(s, d):
    return extract.contained_names(documents(s, d), table(s, d, "supplier_ref").select(F.col("ref_id").alias("name_id"), F.col("ref_name").alias("name")))


# --- joins, merges, state


@query(f"with c as (select document_path, max(corrected_supplier) n from {Q} where trim(corrected_supplier) <> '' group by 1) select entry_id, case when n is not null and n is distinct from supplier then n else supplier end supplier, case when n is not null and n is distinct from supplier then 'manual' else 'auto' end supplier_source from {Q} q left join c using (document_path)")
def j06_corrections(s, d):
    q = once(s, d, "quarantine", "entry_id")
    c = q.select("document_path", F.col("corrected_supplier").alias("supplier"))
    return store.override(q.select("entry_id", "document_path", "supplier"), c, "document_path", "supplier").select("entry_id", "supplier", "supplier_source")


@query(f"with r as (select distinct owner_scope, lower(trim(regexp_replace(sha256,'^.*:',''))) sha from document_fingerprints where owner_scope is not null) select batch_no, count(*) n, count(r.sha) known from {U} u left join r on u.owner_scope = r.owner_scope and lower(trim(u.sha256)) = r.sha where batch_no >= 1 group by batch_no")
def j14_known_files(s, d):
    k = store.known_and_new(table(s, d, "uploads"), table(s, d, "document_fingerprints")).where("batch_no >= 1")
    return k.groupBy("batch_no").agg(F.count("*").alias("n"), F.count_if("known").alias("known"))


@query(f"select owner_scope, lower(trim(sha256)) sha256, min(ts) first_seen_at, max(ts) last_seen_at, count(*) seen_count, arg_max(original_name, (ts, upload_id)) filter (where ts is not null) original_name, arg_max(file_id, (ts, upload_id)) last_file_id from {U} where sha256 is not null and owner_scope is not null group by 1, 2".replace("arg_max(original_name, (ts, upload_id)) filter (where ts is not null) original_name", "list(original_name order by ts desc, upload_id desc)[1] original_name"))
def a30_registry(s, d):
    return store.registry(table(s, d, "uploads"))


@query(f"select entry_id, document_path, reviewed from (select *, row_number() over (partition by document_path order by quarantined_at desc nulls last, entry_id desc) k from {Q}) where k = 1")
def w09_latest_entries(s, d):
    return store.latest(table(s, d, "quarantine").select("entry_id", "document_path", "reviewed", "quarantined_at").dropDuplicates(["entry_id"]), ["document_path"], ["quarantined_at", "entry_id"]).select("entry_id", "document_path", "reviewed")


@query(f"select doc_id, candidate_id, date_str from (select *, row_number() over (partition by doc_id order by case label when 'Rechnungsdatum' then 0 when 'Lieferdatum' then 1 else 2 end, confidence desc nulls last, candidate_id) k from {D}) where k = 1")
def w01_best_candidates(s, d):
    c = once(s, d, "date_candidates", "candidate_id")
    rank = F.when(F.col("label") == "Rechnungsdatum", 0).when(F.col("label") == "Lieferdatum", 1).otherwise(2)
    return store.top_n(c, ["doc_id"], [rank, F.desc_nulls_last("confidence"), F.col("candidate_id")], 1).select("doc_id", "candidate_id", "date_str")


@query(f"select upload_id, case when k = 0 then original_name else regexp_replace(original_name,'\\.[^.]*$','') || '_' || lpad(cast(k as varchar), greatest(2, length(cast(k as varchar)))::integer, '0') || regexp_extract(original_name,'(\\.[^.]*)$',1) end unique_name from (select upload_id, original_name, row_number() over (partition by owner_scope, original_name order by upload_id) - 1 k from {U} where original_name is not null)")
def w08_unique_names(s, d):
    u = once(s, d, "uploads", "upload_id").where("original_name is not null")
    return store.unique_names(u, "owner_scope", "original_name", "upload_id").select("upload_id", "unique_name")


@query(f"select owner_scope, upload_id, file_id from (select *, row_number() over (partition by owner_scope order by ts desc nulls last, upload_id desc) k from {U}) where k <= 20")
def w12_recent(s, d):
    return store.top_n(once(s, d, "uploads", "upload_id"), ["owner_scope"], [F.desc_nulls_last("ts"), F.desc("upload_id")], 20).select("owner_scope", "upload_id", "file_id")


@query(f"select entry_id, coalesce(lead(entry_id) over (partition by owner_scope order by entry_id), min(entry_id) over (partition by owner_scope)) next_id from {Q} where not coalesce(reviewed, false)")
def w11_next_in_list(s, d):
    q = once(s, d, "quarantine", "entry_id").where("not coalesce(reviewed, false)")
    return store.next_in_list(q, "owner_scope", "entry_id").withColumnRenamed("next", "next_id")


@query(f"with o as (select * from {U} where batch_no = 0), n as (select * from {U} where batch_no >= 1), o1 as (select sha256 k, min(upload_id) ord, min(ts) first_ts, max(file_id) file_id from o where sha256 is not null group by 1), n1 as (select sha256 k, min(upload_id) ord, min(ts) first_ts, max(file_id) file_id from n where sha256 is not null group by 1) select k, coalesce(o1.ord, n1.ord) ord, case when n1.k is not null then n1.first_ts else o1.first_ts end first_ts, coalesce(o1.file_id, n1.file_id) file_id, case when o1.k is not null then 0 else 1 end side from o1 full join n1 using (k)")
def u01_merge_results(s, d):
    u = once(s, d, "uploads", "upload_id").where("sha256 is not null")
    side = lambda x: x.groupBy(F.col("sha256").alias("k")).agg(F.min("upload_id").alias("ord"), F.min("ts").alias("first_ts"), F.max("file_id").alias("file_id"))
    return store.merge_results(side(u.where("batch_no = 0")), side(u.where("batch_no >= 1")), "k", ["file_id"])


@query(f"select (select count(*) from {U} where ts is null or ts >= timestamp '2025-06-01' - interval 180 day) kept, (select count(*) from {U} where ts >= timestamp '2025-06-01' - interval 180 day) kept_strict")
def u05_retention(s, d):
    u = once(s, d, "uploads", "upload_id")
    a = store.retain(u, "ts", "2025-06-01", 180).agg(F.count("*").alias("kept"))
    return a.join(F.broadcast(store.retain(u, "ts", "2025-06-01", 180, False).agg(F.count("*").alias("kept_strict"))))  # one row each


@query(f"select file_id, canonical_name, max(confidence) confidence, count(*) n from {M} group by 1, 2")
def u07_best_per_key(s, d):
    return once(s, d, "supplier_matches", "match_id").groupBy("file_id", "canonical_name").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


@query(f"""with s as (select supplier_id, name, aliases, {KEY.format('name')} k from {S} where name is not null), n as (select k, min(name) as name, count(*) n_rows from s where k <> '' group by k),
 a as (select k, {KEY.format('alias')} ak, min(alias) alias from (select k, unnest(aliases) alias from s where k <> '') where alias is not null group by 1, 2), b as (select k, string_agg(alias, '|' order by alias) aliases from a where ak <> '' and ak <> k group by k)
 select name, n_rows, coalesce(aliases,'') aliases from n left join b using (k)""")
def u11_merge_aliases(s, d):
    return store.merge_aliases(once(s, d, "suppliers", "supplier_id"), X.supplier_key)


@query(f"with t as (select document_type, quarantined_at >= timestamp '2024-06-01' cur from {Q} where quarantined_at is not null), g as (select coalesce(document_type,'') category, count(*) filter (where cur) cur, count(*) filter (where not cur) ref from t group by 1), s as (select sum(cur)::double ct, sum(ref)::double rt from g) select category, cur, ref, round((greatest(cur,0.5)/ct - greatest(ref,0.5)/rt) * ln((greatest(cur,0.5)/ct) / (greatest(ref,0.5)/rt)), 6) psi from g, s")
def u16_drift(s, d):
    q = once(s, d, "quarantine", "entry_id")
    return report.stability(q, "document_type", F.col("quarantined_at") >= F.expr("timestamp_ntz'2024-06-01'"))


@query("select doc_id, case when ('0x' || substr(sha256('42:' || cast(doc_id as varchar)),1,8))::bigint % 100 < 80 then 'train' else 'test' end part from documents")
def u19_split(s, d):
    return store.hash_split(documents(s, d), "doc_id", 80, 42).select("doc_id", "part")


# --- reports


@query(f"with g as (select coalesce(nullif(trim(document_type),''),'SONSTIGES') document_type, count(*) n, count(*) filter (where coalesce(reviewed,false)) reviewed from {Q} group by 1) select document_type, n, reviewed, round(n / (sum(n) over ()), 6)::double as share from g")
def a01_summary(s, d):
    q = once(s, d, "quarantine", "entry_id")
    t = F.coalesce(F.nullif(F.trim("document_type"), F.lit("")), F.lit("SONSTIGES"))
    g = q.groupBy(t.alias("document_type")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("reviewed", F.lit(False))).alias("reviewed"))
    return g.select("document_type", "n", "reviewed", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))  # one row a type


@query(f"select supplier, count(*) n from {Q} where trim(supplier) <> '' group by 1 order by n desc, supplier limit 5")
def a01_top_suppliers(s, d):
    return once(s, d, "quarantine", "entry_id").where("trim(supplier) <> ''").groupBy("supplier").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "supplier").limit(5)


@query(f"select method, count(*) n, count(*) filter (where success) ok, round(avg(case when processing_time > 0 then processing_time end), 6) mean_time, round(count(*) filter (where success) / count(*), 6)::double success_rate from {O} group by method")
def a02_processing(s, d):
    o = once(s, d, "ocr_results", "ocr_id")
    return o.groupBy("method").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.round(F.avg(F.when(F.col("processing_time") > 0, F.col("processing_time"))), 6).alias("mean_time"), F.round(F.try_divide(F.count_if("success"), F.count("*")), 6).alias("success_rate"))


@query(" union all ".join(f"select '{c}' metric, count({c}) n, round(avg({c}),6) mean, round(quantile_cont({c}::double,0.5),6) p50, round(quantile_cont({c}::double,0.95),6) p95, round(quantile_cont({c}::double,0.99),6) p99 from {O}" for c in ("confidence", "processing_time")))
def a03_percentiles(s, d):
    return report.percentiles(once(s, d, "ocr_results", "ocr_id"), ["confidence", "processing_time"])


@query(f"select method, list(processing_time order by processing_time)[least(cast(floor(count(*) * 0.95) as bigint), count(*) - 1) + 1] as value, count(*) n from {O} where processing_time is not null group by method")
def a04_nearest_rank(s, d):
    return report.nearest_rank(once(s, d, "ocr_results", "ocr_id"), "method", "processing_time", 0.95)


@query(f"select substr(regexp_replace(trim(split_part(coalesce(error,''),':',1)),' +','_','g'),1,40) error_type, count(*) n from {O} where not success group by 1")
def a05_error_types(s, d):
    return once(s, d, "ocr_results", "ocr_id").where("not success").groupBy(X.error_type(F.coalesce("error", F.lit(""))).alias("error_type")).agg(F.count("*").alias("n"))


@query(f"select owner_scope, count(*) n, count(*) filter (where batch_no >= 1) fresh, max(ts) latest, grouping(owner_scope) as total from {U} group by rollup (owner_scope)")
def a06_site_activity(s, d):
    u = once(s, d, "uploads", "upload_id")
    return u.rollup("owner_scope").agg(F.count("*").alias("n"), F.count_if(F.col("batch_no") >= 1).alias("fresh"), F.max("ts").alias("latest"), F.grouping("owner_scope").cast("long").alias("total"))


@query("select user_id, event_type, n from (select user_id, event_type, count(*) n, row_number() over (partition by user_id order by count(*) desc, min(ts), event_type) k from events group by 1, 2) where k <= 2")
def a11_top_usage(s, d):
    g = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("t"))
    return store.top_n(g, ["user_id"], [F.desc("n"), F.col("t"), F.col("event_type")], 2).select("user_id", "event_type", "n")


@query(f"select document_type, count(*) n from {L} where text is not null and document_type is not null group by 1 having count(*) >= 10")
def a13_training_counts(s, d):
    return once(s, d, "labeled_documents", "label_id").where("text is not null and document_type is not null").groupBy("document_type").agg(F.count("*").alias("n")).where("n >= 10")


@query(r"select lang, source, count(*) n, cast(sum(length(text)) as bigint) chars, cast(sum(len(list_filter(regexp_split_to_array(text,'[ \t\r\n]+'), lambda w: w <> ''))) as bigint) words from documents group by 1, 2")
def a22_metadata(s, d):
    words = F.size(F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != ""))
    return documents(s, d).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.when(F.col("text").isNotNull(), words)).alias("words"))


@query(f"""with c as (select corrected_doctype t, document_type g from {Q} where corrected_doctype is not null and document_type is not null), l as (select t label from c union select g from c),
 p as (select label, (select count(*) from c where t = label and g = label)::double hit, (select count(*) from c where t = label)::double t, (select count(*) from c where g = label)::double g from l),
 f as (select *, case when g = 0 then 0 else hit / g end p, case when t = 0 then 0 else hit / t end r from p)
 select count(*) n_labels, cast(sum(t) as bigint) n, round(sum(hit)/sum(t),6) accuracy, round(avg(p),6) macro_precision, round(avg(r),6) macro_recall, round(avg(case when p + r = 0 then 0 else 2*p*r/(p+r) end),6) macro_f1 from f""")
def a25_type_quality(s, d):
    return report.classification(once(s, d, "quarantine", "entry_id"), "corrected_doctype", "document_type")


@query(f"select le, count(processing_time) filter (where le is null or processing_time <= le) n from {O}, (values (0.5::double),(1.0),(2.0),(5.0),(10.0),(null)) b(le) group by le")
def a32_histogram(s, d):
    return report.histogram(once(s, d, "ocr_results", "ocr_id"), "processing_time", [0.5, 1, 2, 5, 10])


# --- vectors


COS = "round(list_cosine_similarity(cast(q.embedding as double[]), cast(r.embedding as double[])), 6)"


@query(f"select query_id, vec_id, score, cast(k as integer) as rank from (select q.vec_id query_id, r.vec_id, {COS} score, row_number() over (partition by q.vec_id order by {COS} desc, r.vec_id) k from embeddings q, embeddings r where q.vec_id % 50 = 0 and q.vec_id <> r.vec_id) where k <= 10")
def v02_nearest(s, d):
    e = table(s, d, "embeddings")
    return vectors.top_k(e.where("vec_id % 50 = 0"), e, 10)


@query(f"select query_id, vec_id, score from (select q.vec_id query_id, r.vec_id, {COS} score, row_number() over (partition by q.vec_id order by {COS} desc, r.vec_id) k from embeddings q, embeddings r where q.vec_id % 50 = 0 and q.vec_id <> r.vec_id) where k <= 10 and score >= 0.35")
def v03_duplicates(s, d):
    e = table(s, d, "embeddings")
    return vectors.duplicates(e.where("vec_id % 50 = 0"), e, 0.35).select("query_id", "vec_id", "score")


@query("select cast(sqrt(count(*)) as bigint) n, round(avg(c),6) mean, round(stddev_pop(c),6) std from (select list_cosine_similarity(cast(q.embedding as double[]), cast(r.embedding as double[])) c from embeddings q, embeddings r)")
def a24_similarity(s, d):
    return vectors.pair_statistics(table(s, d, "embeddings"))


@query(f"with k as (select query_id, qi, ri, k from (select q.vec_id query_id, q.label qi, r.label ri, row_number() over (partition by q.vec_id order by {COS} desc, r.vec_id) k from embeddings q, embeddings r where q.vec_id % 50 = 0 and q.vec_id <> r.vec_id) where k <= 10), b as (select query_id, min(case when qi = ri then k end) r from k group by 1) select count(*) queries, round(avg(coalesce(1.0/r,0)),6)::double mrr, " + ", ".join(f"round(avg(case when r <= {k} then 1.0 else 0.0 end),6)::double recall_{k}" for k in (1, 3, 5, 10)) + " from b")
def a23_retrieval(s, d):
    e = table(s, d, "embeddings")
    return vectors.retrieval_metrics(vectors.top_k(e.where("vec_id % 50 = 0"), e, 10), e)


# --- event time


@query("select start, event_type, count(*) n, round(sum(value),4) total from (select event_type, value, unnest(generate_series(time_bucket(interval 15 minute, ts) - interval 45 minute, time_bucket(interval 15 minute, ts), interval 15 minute)) start from events) group by 1, 2")
def t10_sliding_rates(s, d):
    return jobs.rates(table(s, d, "events"), "60 minutes", "15 minutes")


@query("with g as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end b from events), k as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) sid from g) select user_id, min(ts) start, count(*) n, round(sum(value),4) total from k group by user_id, sid")
def t11_sessions(s, d):
    return jobs.sessions(table(s, d, "events"))


@query("select user_id, event_type, count(*) n from events group by 1, 2")
def t05_usage(s, d):
    return jobs.usage(table(s, d, "events"))


@query(f"select owner_scope, lower(trim(sha256)) sha256, min(upload_id) upload_id from {U} where sha256 is not null group by 1, 2")
def t04_first_sightings(s, d):
    return once(s, d, "uploads", "upload_id").where("sha256 is not null").groupBy("owner_scope", F.lower(F.trim("sha256")).alias("sha256")).agg(F.min("upload_id").alias("upload_id"))


@query("select orderday, n, revenue from (select cast(o_orderdate as date) orderday, count(*) n, round(sum(o_totalprice),2) revenue from orders group by 1)")
def a02_orders_by_day(s, d):
    return table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("orderday")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
