"""The operators' queries over the whole driver tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.chunk_dedup import chunk_dedup
from quillon.llm.common import clear
from quillon.llm.decontaminate import leaks
from quillon.llm.exact_dedup import exact_dedup
from quillon.llm.mixing import mix_sources
from quillon.llm.near_dedup import near_dedup
from quillon.llm.pii import BASE, find_pii
from quillon.llm.quality import classify_quality, training_fold
from quillon.llm.suffix_dedup import suffix_dedup
from quillon.llm.url_filter import filter_urls
from quillon.llm.warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def removal_digests(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(suffix_dedup(_table(spark, sf_dir, "documents")))


# bytes as pairs of hexadecimal digits; long texts are cut into overlapping blocks first, as a window's place is found by counting
_OP1 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
b as (select doc_id, place, substr(h, place + 1, 1122) t from (select doc_id, h, unnest(range(0, length(h), 1024)) place from d)),
w as (select doc_id, place // 2 + i as pos, substr(t, 2 * i + 1, 100) s from (select doc_id, place, t, unnest(range(0, (length(t) - 98) // 2)) i from b where length(t) >= 100)),
m as (select s, min(doc_id) low from w group by s having count(*) > 1),
g as (select doc_id, pos from w join m using (s) where low < doc_id),
n as (select *, pos > coalesce(lag(pos) over (partition by doc_id order by pos) + 50, -1) as fresh from g),
r as (select *, sum(fresh::int) over (partition by doc_id order by pos) run from n),
v as (select doc_id, run, min(pos) a, max(pos) + 50 z from r group by doc_id, run),
k as (select doc_id, h, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) from_, row_number() over (partition by doc_id order by a) i from v join d using (doc_id)),
o as (select doc_id, sum(z - a) n_removed, count(*) n_spans, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' order by i) || substr(any_value(h), 2 * max(z) + 1) kept from k group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join o using (doc_id)
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"))


_OP2 = r"""
with recursive w as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as reached from documents union select r.doc_id, e.b from r join e on r.reached = e.a),
c as (select doc_id, min(reached) component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join c on d.doc_id = c.doc_id left join n on d.doc_id = n.doc_id
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(spark, write_archives(_table(spark, sf_dir, "pages")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP3 = """
with p as (select page_id, coalesce(html, '') h from pages),
g as (select page_id, cast(strlen(h) as bigint) payload_bytes, sha1(h) payload_digest, max(page_id) over (partition by h) top from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from g
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(of(*BASE)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", (training_fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    first = F.round(F.array_min(F.col("plays.position")), 9).alias("position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("position", "doc_id")


_OP6 = r"""
with d as (select doc_id, source, cast(case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as bigint) size,
                  md5(coalesce(cast(doc_id as varchar), text, '')) place from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 turn, cast(2 * source_size as double) cap from s),
v as (select *, [5.0::double, 2.0, 1.0][turn + 1] weight from w),
r as (select *, least(sum(source_size) over () * 1.5::double, sum(cap) over ()) wanted,
             coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0) cap_before,
             sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) weight_left from v),
l as (select *, (wanted - cap_before) / weight_left lvl from r),
c as (select *, lvl * weight >= cap capped from l),
e as (select *, (select lvl from c where not capped order by cap / weight, source_size, lvl limit 1) final from c),
t as (select source, source_size, turn, case when capped then cap else least(cap, final * weight) end target from e),
p as (select d.doc_id, d.size, t.source_size, t.target, t.turn,
             sum(d.size) over (partition by d.source order by d.place, d.doc_id rows unbounded preceding) - d.size start
      from d join t on d.source is not distinct from t.source),
k as (select *, greatest(0, least(size, floor(target) - start)) first_take, greatest(0, least(size, floor(target) - source_size - start)) second_take, start / target u from p)
select doc_id, size, source_size, target, cast(first_take + second_take as bigint) taken,
       case when first_take > 0 then round(least(case turn when 0 then 2.0::double * (u * 5.0::double) / (sqrt(greatest(36.0::double + -4.0::double * (u * 5.0::double), 0)) + 6.0::double)
                                               when 1 then 2.0::double * (u * 2.0::double) / (sqrt(4.0::double) + 2.0::double)
                                               else case when u > 0 then 2.0::double * (u * 1.0::double) / sqrt(4.0::double * (u * 1.0::double)) else 0 end end, 1.0), 9) end as position
from k
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("copies")


_OP8 = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') body from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, sha256(body) as text_sha256
from n window g as (partition by body)
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "best_window", "aligned")


_OP7 = r"""
with d as (select distinct doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents),
b as (select distinct item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') v from benchmark),
i as (select item_id, len(v) n, unnest(v) token, unnest(range(len(v))) as pos from b),
t as (select doc_id, unnest(w) token, unnest(range(len(w))) as pos from d),
h as (select doc_id, item_id, n, t.pos - i.pos as diagonal, i.pos as pos, (13 * least(n, 16) + 15) // 16 as need from t join i on t.token = i.token),
g as (select * from h qualify count(*) over (partition by doc_id, item_id, n, diagonal) >= need),
k as (select doc_id, item_id, n, need, diagonal, count(*) over (partition by doc_id, item_id, n, diagonal order by pos range between 15 preceding and current row) best,
             count(*) over (partition by doc_id, item_id, n, diagonal) aligned from g),
q as (select doc_id, item_id, max(best) best_window, max(aligned) aligned from k group by doc_id, item_id, n, need, diagonal having max(best) >= need)
select doc_id, item_id, cast(best_window as int) best_window, cast(aligned as int) aligned from q
qualify row_number() over (partition by doc_id, item_id order by best_window desc, aligned desc) = 1
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages")).drop("score")


_OP9 = r"""
with r as (select page_id, url,
             translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') h,
             regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) p,
             regexp_replace(regexp_replace(regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?s)^.*?://', ''), '[0-9]', '0', 'g'), '[^a-z0./_?=&#:-]', '*', 'g') form
      from pages),
u as (select page_id, coalesce(h, '') host, coalesce(p, '') path, form from r),
f as (select *, case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
                     when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
                     when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
                     when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end rule from u),
v as (select *, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' end ruled from f),
z as (select *, ('0x' || substr(md5(form), 1, 4))::int % 5 = 0 held_out from v),
c as (select g, count(*) filter (ruled = 'allow' and not held_out) a, count(*) filter (ruled = 'block' and not held_out) b
      from (select ruled, held_out, unnest(list_transform(range(1, len(form) + 2), lambda i: substr('^^^' || form || '$', i, 4))) g from z) group by g),
o0 as (select g, a, b, (sum(a) over (partition by substr(g, 4, 1)) + 4.0::double * (1.0::double / 38)) / (sum(a) over () + 4.0::double) pa,
                       (sum(b) over (partition by substr(g, 4, 1)) + 4.0::double * (1.0::double / 38)) / (sum(b) over () + 4.0::double) pb from c),
o1 as (select g, a, b, (sum(a) over (partition by substr(g, 3, 2)) + 4.0::double * pa) / (sum(a) over (partition by substr(g, 3, 1)) + 4.0::double) pa,
                       (sum(b) over (partition by substr(g, 3, 2)) + 4.0::double * pb) / (sum(b) over (partition by substr(g, 3, 1)) + 4.0::double) pb from o0),
o2 as (select g, a, b, (sum(a) over (partition by substr(g, 2, 3)) + 4.0::double * pa) / (sum(a) over (partition by substr(g, 2, 2)) + 4.0::double) pa,
                       (sum(b) over (partition by substr(g, 2, 3)) + 4.0::double * pb) / (sum(b) over (partition by substr(g, 2, 2)) + 4.0::double) pb from o1),
o3 as (select g, (a + 4.0::double * pa) / (sum(a) over (partition by substr(g, 1, 3)) + 4.0::double) pa,
                 (b + 4.0::double * pb) / (sum(b) over (partition by substr(g, 1, 3)) + 4.0::double) pb from o2),
k as (select g, round((ln(pa) - ln(pb)) * 1e6) ratio from o3),
s as (select form, sum(ratio) / count(*) / 1e6 mean from (select form, unnest(list_transform(range(1, len(form) + 2), lambda i: substr('^^^' || form || '$', i, 4))) g from (select distinct form from z)) join k using (g) group by form),
m as (select count(*) filter (ruled = 'allow') n, avg(mean) filter (ruled = 'allow') x, sqrt(greatest(avg(mean * mean) filter (ruled = 'allow') - (avg(mean) filter (ruled = 'allow')) ** 2, 0)) + 1e-9 dx,
             count(*) filter (ruled = 'block') nb, avg(mean) filter (ruled = 'block') y, sqrt(greatest(avg(mean * mean) filter (ruled = 'block') - (avg(mean) filter (ruled = 'block')) ** 2, 0)) + 1e-9 dy
      from z join s using (form) where held_out),
t as (select case when n > 0 and nb > 0 then round((x * dy + y * dx) / (dx + dy), 9) else 0 end bar from m)
select page_id, host, path, rule, coalesce(ruled, case when mean - bar >= 0 then 'allow' else 'block' end) verdict from z join s using (form), t
"""


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per removed span, with the smallest id that has (a chunk of) it; documents that lose nothing have none."""
    found = chunk_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("spans").alias("span")).select("doc_id", "span.first_id", "span.start", "span.end")


__all__ = ["ORACLES", "QUERIES", "clear"]

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_chunk_dedup": op10_chunk_dedup,
}
ORACLES = {
    "op1_suffix_dedup": _OP1,
    "op2_near_dedup": _OP2,
    "op3_warc": _OP3,
    "op6_mixing": _OP6,
    "op7_decontaminate": _OP7,
    "op8_exact_dedup": _OP8,
    "op9_url_filter": _OP9,
}
