"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from tessera.llm.byte_bpe import op11_byte_bpe
from tessera.llm.html_extract import op8_html_extraction
from tessera.llm.licenses import op10_license_scan
from tessera.llm.media import op4_media_columns
from tessera.llm.mixing import op1_mixing
from tessera.llm.ngram_join import op5_ngram_join
from tessera.llm.packing import op6_best_fit_packing
from tessera.llm.periodic import op13_periodic_runs
from tessera.llm.pii import op3_pii
from tessera.llm.prefix_trie import op12_prefix_trie
from tessera.llm.quality import op2_quality_rules
from tessera.llm.token_files import op7_token_files
from tessera.llm.warc import op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_license_scan": op10_license_scan,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_periodic_runs": op13_periodic_runs,
        "op1_mixing": op1_mixing,
        "op2_quality_rules": op2_quality_rules,
        "op3_pii": op3_pii,
        "op4_media_columns": op4_media_columns,
        "op5_ngram_join": op5_ngram_join,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_token_files": op7_token_files,
        "op8_html_extraction": op8_html_extraction,
        "op9_warc": op9_warc,
        "pipeline": corpus_pipeline.run,
    }


NGRAM_JOIN = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from w)),
n as (select doc_id, count(*) n from sh group by doc_id),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
both_ as (select x, y from links union all select y, x from links),
reach as (select x, y from both_ union select reach.x, both_.y from reach join both_ on both_.x = reach.y)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) component_id
from documents d left join n using (doc_id) left join reach r on r.x = d.doc_id group by d.doc_id, n.n
"""

WARC = """
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x from pages),
m as (select x, max(page_id) last from p group by x)
select page_id, cast(octet_length(encode(h)) as bigint) payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast('0x' || substr(p.x, cast(1 + 10 * (i // 8) as int), 10) as bigint) >> cast(35 - 5 * (i % 8) as int)) & 31) as int), 1)), '') payload_digest,
  case when page_id = last then 'response' else 'revisit' end record_type, case when page_id <> last then last end refers_to
from p join m using (x)
"""

#: The reversed polynomial and the mask of CRC-32.
CRC32 = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(range(1, length({0}) + 1), lambda i: [cast(ord({0}[i]) as bigint), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: case when xor(a, b) & 1 = 1 then xor(xor(a, b) >> 1, 3988292384) else xor(a, b) >> 1 end))"""

PREFIX_TRIE = f"""
with t as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, md5(concat(length(coalesce(role, '')), ':', role, text))) k, md5(concat(length(coalesce(role, '')), ':', role, text)) id, cast(length(coalesce(text, '')) as bigint) n from conversations where conv_id is not null),
h as (select c, cast({CRC32.format("cast(c as varchar)")} % 6 as bigint) h from (select distinct c from t)),
r as (select h.c, 0 own, t.k, t.id, t.n from h join t on t.c = h.c - h.c % 100 where t.k <= h.h union all select h.c, 1, t.k, t.id, t.n from h join t on t.c = h.c where t.k > h.h),
l as (select c, list({{'id': id, 'n': n}} order by own, k) x from r group by c),
s as (select h.c, coalesce(l.x, []) x from h left join l using (c)),
p as (select c, unnest(range(0, len(x) + 1)) d, x from s),
q as (select c, d, len(x) = d ends, md5(array_to_string(list_transform(x[1:d], lambda y: y.id), '')) key, case when d > 0 then x[d].n else 0 end n from p),
m as (select key, d, min(c) first, count(*) m, any_value(n) n, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where ends), '')) e from q group by key, d),
up as (select m.key, m.d, m.first, q.key above from m left join q on q.c = m.first and q.d = m.d - 1),
kids as (select above key, d - 1 d, count(*) k from up where above is not null group by above, d),
own as (select m.*, coalesce(kids.k, 0) k from m left join kids using (key, d)),
sums as (select q.key, q.d, sum((own.m - 1) * own.n) saved, count(*) filter (where own.k = 0) leaves from own join q on q.c = own.first and q.d <= own.d group by q.key, q.d)
select own.first conv_id, cast(own.d as bigint) depth, a.first parent_conv_id, own.m n_convs, own.k n_children, cast(sums.leaves as bigint) n_leaves, cast(sums.saved as bigint) saved_tokens, own.e ends_sha256
from own join up using (key, d) join sums using (key, d) left join m a on a.key = up.above and a.d = own.d - 1
"""

PERIODIC_RUNS = f"""
with recursive w as (select row_number() over () r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
h as (select *, case when doc_id is not null then {CRC32.format("cast(doc_id as varchar)")} else 1 end h from w),
a as (select *, cast(case when len(w) > 0 then (h // 10) % len(w) else 0 end as bigint) a from h),
p as (select *, 1 + (len(w) - a) // (3 + (h // 10) % 8) p from a),
t as (select r, doc_id, case when h % 10 = 0 then list_transform(range(0, len(w)), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) else w end w from p),
f as (select r, len(w) n, unnest(range(0, len(w) - 4)) i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) g from t where len(w) >= 6),
d as (select x.r, x.i, x.i - y.i q from f x join f y on x.r = y.r and x.g = y.g and y.i < x.i and 4 * (x.i - y.i) <= x.n),
m as (select r, q, min(i) - q s, max(i) + 5 e from (select *, i - row_number() over (partition by r, q order by i) z from d) group by r, q, z),
u as (select r, s, e, min(q) q from m where e - s >= greatest(6, 4 * q) group by r, s, e),
k as (select r, count(*) n_runs, string_agg(concat(s, ',', e - s, ',', q, chr(10)), '' order by s, q) lines, list({{'s': s, 'n': e - s, 'q': q}} order by s, q) x from u group by r),
o as (select r, unnest(range(1, len(w) + 1)) i, unnest(w) v from t where r in (select r from u)),
g as (select o.r, string_agg(o.v, ' ' order by o.i) v from o where not exists (select 1 from u where u.r = o.r and o.i > u.s + u.q and o.i <= u.e) group by o.r),
b as (select r, list_reduce(x, lambda a, b: case when b.n * a.q > a.n * b.q then b else a end) b from k)
select t.doc_id, coalesce(k.n_runs, 0) n_runs, b.b.s as start, b.b.n as length, b.b.q as period, 1000 * b.b.n // b.b.q exponent_milli,
  sha256(coalesce(k.lines, '')) runs_sha256, sha256(case when k.r is null then array_to_string(t.w, ' ') else coalesce(g.v, '') end) collapsed_sha256
from t left join k using (r) left join b using (r) left join g using (r)
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested against brute force."""
    return {"op5_ngram_join": NGRAM_JOIN, "op9_warc": WARC, "op12_prefix_trie": PREFIX_TRIE, "op13_periodic_runs": PERIODIC_RUNS}
