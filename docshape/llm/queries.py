"""Thin queries over the driver tables, each through its operator, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, gif, langid, line_dedup, minhash, quality, secret_scan, suffix_dedup, url_filter
from .staging import new_path

#: The public vocabulary that op5 and op6 use; any rank file of a byte-level BPE will do.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), words_per_shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def _of_kinds(kinds: list[str]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(kinds))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a first load with about half of the documents, then one with all: the second scans only what is new
    early = docs.where(F.crc32(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")) % 2 == 0)
    found = secret_scan.history(spark, [early, docs], new_path(spark, "secret-ledger"))
    kinds = [r.kind for r in secret_scan.RULES]
    number = [F.size(_of_kinds([k])).cast("long").alias(f"n_{k}") for k in kinds]
    base = _of_kinds(kinds)
    return found.select("doc_id", *number, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digests(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(spark, docs, quality.grades_of(table(spark, sf_dir, "labels")))
    found = quality.score(docs, model)
    return found.select("doc_id", "expected_grade", F.get("tails", F.lit(0)).alias("p_grade_1"), F.get("tails", F.lit(1)).alias("p_grade_2"), "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    vocabulary = list(bpe.parse_ranks(bpe.read_ranks(vocabulary_path())))
    model = langid.train(spark, docs.where(~held_out).select("text", "lang"), vocabulary)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(spark, table(spark, sf_dir, "documents"), bpe.read_ranks(vocabulary_path()))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "longest",
        F.array_join("near_ids", ",").alias("near_items"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_boilerplate(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_minhash_near_dedup,
            op2_secret_scan,
            op3_gif_media,
            op4_quality_classifier,
            op5_language_id,
            op6_byte_bpe,
            op7_suffix_dedup,
            op8_decontamination,
            op9_url_filter,
            op10_line_dedup,
        )
    }


_OP1 = r"""
with recursive low as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) end s from low
), sorted_sets as (select doc_id, list_sort(s) s from sets where len(s) > 0),
one as (select min(doc_id) rep, len(s) n, s from sorted_sets group by s),
each as (select rep, n, unnest(s) g from one),
busy as (select g from each group by g having count(*) > 1),
pairs as (
  select a.rep a, b.rep b, count(*) i, any_value(a.n) na, any_value(b.n) nb
  from each a join each b on a.g = b.g and a.rep < b.rep join busy on busy.g = a.g group by 1, 2
), links as (select a, b from pairs where 100 * i >= 80 * (na + nb - i)),
both_ways as (select a, b from links union all select b, a from links),
reach(node, root) as (select rep, rep from one union select b.b, r.root from reach r join both_ways b on b.a = r.node),
part as (select node, min(root) component from reach group by node)
select s.doc_id, cast(len(s.s) as bigint) n_shingles, coalesce(p.component, s.doc_id) component_id, s.doc_id = coalesce(p.component, s.doc_id) kept
from sets s left join sorted_sets z on z.doc_id = s.doc_id left join one o on o.s = z.s left join part p on p.node = o.rep
"""

_ASSIGN = """(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _op2() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        parts.append(
            f"""select doc_id, '{kind}' kind, {rank} kind_rank, unnest(list_transform(range(1, len(m) + 1), lambda i:
              {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'n': length(m[i]), 'p': length(p[i])}})) x
            from (select doc_id, string_split_regex(t, '{pattern}') g, regexp_extract_all(t, '{pattern}', 0) m, regexp_extract_all(t, '{pattern}', {group}) p from texts)"""
        )
    wanted = "(kind = 'assign' and x.p >= 6) or (kind = 'access' and x.p >= 20) or (kind = 'hex' and x.p >= 24)"
    return f"""
with texts as (select doc_id, coalesce(text, '') t from documents),
hits as ({' union all '.join(parts)}),
spans as (select doc_id, kind, kind_rank, cast(x.s as bigint) s, cast(x.s + x.n as bigint) e from hits where {wanted}),
listed as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_rank) spans from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans
from documents d left join listed l on l.doc_id = d.doc_id
"""


#: Bytes as two hex digits each; texts are cut in pieces first, as substr reads its text from the start.
_OP7 = r"""
with texts as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
pieces as (select doc_id, low, substr(h, 2 * low + 1, 610) piece from (select doc_id, h, unnest(range(0, length(h) // 2 - 49, 256)) low from texts where length(h) >= 100)),
starts as (select doc_id, low + o p, substr(piece, 2 * o + 1, 100) s from (select doc_id, low, piece, unnest(range(least(256, length(piece) // 2 - 49))) o from pieces)),
firsts as (select s, min(doc_id) doc from starts group by s having min(doc_id) < max(doc_id)),
hits as (select doc_id, p, lag(p) over (partition by doc_id order by p) last_p from (select t.doc_id, t.p from starts t join firsts f on f.s = t.s where t.doc_id > f.doc)),
runs as (select doc_id, p, sum(case when p <= last_p + 50 then 0 else 1 end) over (partition by doc_id order by p) run from hits),
spans as (select doc_id, min(p) low, max(p) + 50 high from runs group by doc_id, run),
gaps as (
  select doc_id, low, coalesce(lag(high) over (partition by doc_id order by low), 0) before, high, lead(low) over (partition by doc_id order by low) is null final from spans
), kept as (
  select g.doc_id, count(*) n_spans, sum(high - low) n_removed,
    string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' order by low) || any_value(substr(h, 2 * high + 1)) filter (final) k
  from gaps g join texts t on t.doc_id = g.doc_id group by g.doc_id
)
select t.doc_id, cast(length(h) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(k, h))) kept_sha256
from texts t left join kept k on k.doc_id = t.doc_id
"""

_OP8 = r"""
with split as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents
), items as (
  select cast(item_id as varchar) item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark
), windows as (
  select distinct item_id, n, array_to_string(w[i:i+n-1], ' ') g from (select item_id, w, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from items where len(w) > 0)
), sizes as (select distinct n from windows),
places as (select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from split, sizes where len(w) >= n)),
hits as (select p.doc_id, p.i, p.n, x.item_id from places p join windows x on x.g = p.g and x.n = p.n),
covered as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(range(i, i + n)) pos from (select distinct doc_id, i, n from hits)) group by doc_id),
named as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from hits) group by doc_id),
starts as (select item_id, n, o, array_to_string(w[o:o+n-1], ' ') g from (select item_id, w, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) o from items where len(w) > 0)),
placed as (select distinct h.doc_id, h.item_id, h.n, h.i, h.i - s.o shift from (select doc_id, i, item_id, n, array_to_string(w[i:i+n-1], ' ') g from hits join split using (doc_id)) h join starts s on s.item_id = h.item_id and s.g = h.g),
islands as (select *, i - row_number() over (partition by doc_id, item_id, shift order by i) island from placed),
longest as (select doc_id, max(size) longest from (select doc_id, n - 1 + count(*) size from islands group by doc_id, item_id, n, shift, island) group by doc_id),
terms as (select distinct item_id, unnest(w) term from items),
postings as (select * from (select doc_id, unnest(w) term, unnest(range(len(w))) pos from split) where term in (select term from terms)),
rarest as (
  select * from (select item_id, t.term, row_number() over (partition by item_id order by coalesce(n, 0), t.term) place from terms t left join (select term, count(*) n from postings group by term) f on f.term = t.term) where place <= 3
), seats as (select doc_id, pos, item_id, place, max(place) over (partition by item_id) need from rarest left join postings using (term)),
close as (
  select *, max((place = 1)::int) over w + max((place = 2)::int) over w + max((place = 3)::int) over w met from seats where doc_id is not null
  window w as (partition by doc_id, item_id order by pos range between 13 preceding and 13 following)
), near as (select doc_id, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from close where place = 1 and met = need) group by doc_id)
select s.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(m.ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated, cast(coalesce(longest, 0) as int) longest, coalesce(e.ids, '') near_items
from split s left join covered c on c.doc_id = s.doc_id left join named m on m.doc_id = s.doc_id left join longest l on l.doc_id = s.doc_id left join near e on e.doc_id = s.doc_id
"""

_OP9 = r"""
with recursive rest as (select page_id, url, html, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end r from pages),
cut as (
  select page_id, html, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path, regexp_extract(r, '^[^?#]*\?([^#]*)', 1) query from rest
), spelled as (
  select page_id, html, host, path, case when host = '' then null else host || regexp_replace(path, '/+$', '') || case when kept = '' then '' else '?' || kept end end alias
  from (select *, array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&') kept from cut)
), rules(h, p, block) as (values ('com', '/en/', true), ('example.com', '/en/7', false), ('net', '/de/', true), ('example.net', '/de/8', true), ('org', '/es/', true)),
fits as (
  select page_id, arg_max(h || p, length(h || p)) rule, arg_max(block, length(h || p)) block
  from spelled, rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
), tags as (
  select alias, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)', '', 'g'), '(?is)<(link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*|meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*)>', 1)) tag from spelled
), targets as (select alias, regexp_extract(tag, '(?is)(?:\bhref\s*=\s*["'']?|\burl\s*=\s*[''"]?)([a-z][a-z0-9+.-]*://[^"''\s>]+)', 1) t from tags),
joined as (
  select alias a, translate(regexp_extract(t, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_extract(t, '://[^/?#]*([^?#]*)', 1), '/+$', '') b from targets where t <> '' and alias is not null
), both_ways as (select a, b from joined union select b, a from joined),
reach(node, root) as (select distinct alias, alias from spelled where alias is not null union select e.b, r.root from reach r join both_ways e on e.a = r.node),
part as (select node, min(root) component from reach group by node),
ends as (
  select distinct translate(regexp_extract(t, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(t, '://[^/?#]*([^?#]*)', 1) path from targets where t <> ''
), judged as (
  select alias, block from fits join spelled using (page_id) where alias is not null
  union all select host || regexp_replace(path, '/+$', ''), arg_max(r.block, length(h || p)) from ends, rules r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path
), told as (select component, bool_or(block) and not bool_or(not block) bad from judged j join part p on p.node = j.alias group by component)
select s.page_id, s.host, s.path, f.rule, case when coalesce(f.block, t.bad, false) then 'block' else 'allow' end verdict
from spelled s left join fits f on f.page_id = s.page_id left join part p on p.node = s.alias left join told t on t.component = p.component
"""

_OP10 = r"""
with cut as (select doc_id, coalesce(source, '') site, text, string_split(text, chr(10)) parts from documents),
each as (select doc_id, site, unnest(parts) line, unnest(range(len(parts))) pos from cut where text is not null),
bad as (select trim(line) l, min((doc_id, pos)) keep from (select doc_id, site, line, pos from each where trim(line) <> '') group by trim(line) having count(distinct site) >= 10),
marked as (select e.doc_id, e.pos, e.line, b.l is not null and (e.doc_id, e.pos) <> b.keep gone from each e left join bad b on b.l = trim(e.line)),
kept as (
  select doc_id, count(*) filter (trim(line) <> '') n_lines, count(*) filter (gone) n_removed, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') t from marked group by doc_id
)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, cast(length(k.t) as bigint) n_chars_kept, sha256(k.t) text_sha256 from documents d left join kept k on k.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": _OP1,
        "op2_secret_scan": _op2(),
        "op7_suffix_dedup": _OP7,
        "op8_decontamination": _OP8,
        "op9_url_filter": _OP9,
        "op10_line_dedup": _OP10,
    }
