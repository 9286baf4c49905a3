"""SQL for each query of the catalogue, for another engine to check the results by."""

from __future__ import annotations


def _with(*parts: str, then: str, recursive: bool = False) -> str:
    return f"with {'recursive ' * recursive}{', '.join(parts)} {then}"


LISTED = "select b.item_id, d.doc_id, d.lang, d.source from benchmark b join documents d on contains(d.text, b.text) where b.text <> ''"

# seeds of 12 characters: benchmark passages in documents
SEEDS = (
    "rk as (select item_id r, p, substr(text, p + 1, 12) m from benchmark, unnest(range(0, length(text) - 11)) as a(p))",
    "dc as (select doc_id d, o, substr(text, o + 1, 211) t from documents, unnest(range(0, length(text), 200)) as c(o))",
    "dk as (select d, o + p as q, substr(t, p + 1, 12) m from dc, unnest(range(0, least(200, length(t) - 11))) as a(p))",
    "hits as (select r, d, q - p as diag, p from rk join dk using (m))",
    "marked as (select *, p - row_number() over (partition by r, d, diag order by p) g from hits)",
    "isl as (select r, d, diag, min(p) s, max(p) + 11 e from marked group by r, d, diag, g)",
)
SEED_MS = "ms as (select r, e, min(s) s from (select r, s, unnest(range(s + 11, e + 1)) e from isl) group by r, e)"


def _fold(reads: str) -> tuple[str, ...]:
    """Factors from right to left. reads has r and q."""
    return (
        f"pos as (select p.r, p.e, coalesce(m.s, p.e) s, m.s is not null hit from (select r, unnest(range(0, length(q))) e from {reads}) p left join ms m on m.r = p.r and m.e = p.e)",
        f"fac as (select pos.r, pos.e, pos.s, pos.hit, 0 ord from pos join {reads} x on x.r = pos.r where pos.e = length(x.q) - 1 union all select pos.r, pos.e, pos.s, pos.hit, fac.ord + 1 from fac join pos on pos.r = fac.r and pos.e = fac.s - 1)",
    )


SEEDED = (
    *SEEDS,
    SEED_MS,
    "reads as (select item_id r, text q from benchmark where text <> '')",
    *_fold("reads"),
    "inside as (select distinct fac.r, fac.ord, isl.d from fac join isl on isl.r = fac.r and isl.s <= fac.s and fac.e <= isl.e where fac.hit)",
)


def _exact(column: str) -> tuple[str, ...]:
    """Exact listing of a column of part in benchmark passages: lst(id, ord, s, e, ds)."""
    return (
        f"reads as (select row_number() over (order by q) r, q from (select distinct {column} q from part where {column} <> ''))",
        "sub as (select r, s, e, substr(q, s + 1, e - s + 1) f from reads, unnest(range(0, length(q))) as a(s), unnest(range(0, length(q))) as b(e) where s <= e)",
        "held as (select f, list(distinct item_id order by item_id) ds from (select distinct f from sub) x join benchmark b on contains(b.text, f) group by f)",
        "ms as (select r, e, min(s) s from sub where f in (select f from held) group by r, e)",
        *_fold("reads"),
        f"lst as (select p.p_partkey id, fac.ord, fac.s, fac.e, coalesce(held.ds, []) ds from part p join reads on reads.q = p.{column} join fac on fac.r = reads.r left join held on fac.hit and held.f = substr(reads.q, fac.s + 1, fac.e - fac.s + 1))",
    )


PARTS = _exact("p_name")
# part names in benchmark passages by factors of 3 characters at least; of each the first suffix that begins with it
FIRST = (
    "reads as (select row_number() over (order by q) r, q from (select distinct p_name q from part where p_name <> ''))",
    "sub as (select r, s, e, substr(q, s + 1, e - s + 1) f from reads, unnest(range(0, length(q))) as a(s), unnest(range(0, length(q))) as b(e) where e - s >= 2)",
    "held as (select distinct f from (select distinct f from sub) x join benchmark b on contains(b.text, f))",
    "ms as (select r, e, min(s) s from sub where f in (select f from held) group by r, e)",
    *_fold("reads"),
    "hits as (select r, ord, substr(q, s + 1, e - s + 1) f from fac join reads using (r) where hit)",
    "suf as (select substr(text, p + 1) sfx from benchmark, unnest(range(0, length(text))) as a(p))",
    "firsts as (select f, min(sfx) sfx from (select distinct f from hits) h join suf on starts_with(sfx, f) group by f)",
    "lens as (select f, item_id d, (select coalesce(max(n), 0) from range(1, length(sfx) + 1) t(n) where contains(text, substr(sfx, 1, n))) len from firsts, benchmark)",
    "rec as (select *, length(f) need, coalesce(max(len) over (partition by f order by d rows between unbounded preceding and 1 preceding), 0) lm, coalesce(max(len) over (partition by f order by d rows between 1 following and unbounded following), 0) rm, row_number() over (partition by f order by len desc, d) k from lens)",
)
# reads (r, q) in docs (d, t), every factor: strings of at most 12 characters by the documents' own, longer ones by their first 12
ANY = (
    "sub as (select r, s, e, substr(q, s + 1, e - s + 1) f from reads, unnest(range(0, length(q))) as a(s), unnest(range(0, length(q))) as b(e) where s <= e)",
    "dc as (select d, substr(t, o + 1, 211) t from docs, unnest(range(0, length(t), 200)) as c(o))",
    "own as (select distinct f from sub where length(f) <= 12)",
    "brief as (select distinct d, x.f from (select d, substr(t, p + 1, n) f from dc, unnest(range(0, length(t))) as a(p), unnest(range(1, 13)) as b(n) where p + n <= length(t) and p < 200) x join own using (f))",
    "long as (select distinct x.d, sub.f from sub join brief x on x.f = substr(sub.f, 1, 12) join docs on docs.d = x.d where length(sub.f) > 12 and contains(docs.t, sub.f))",
    "held as (select d, f from brief union all select d, f from long)",
    "ms as (select r, e, min(s) s from sub where f in (select f from held) group by r, e)",
    "pos as (select p.r, p.e, coalesce(m.s, p.e) s, p.q from (select r, q, unnest(range(0, length(q))) e from reads) p left join ms m on m.r = p.r and m.e = p.e)",
    "fac as (select r, e, s, 0 ord, substr(q, s + 1, e - s + 1) f from pos where e = length(q) - 1 union all select pos.r, pos.e, pos.s, fac.ord + 1, substr(pos.q, pos.s + 1, pos.e - pos.s + 1) from fac join pos on pos.r = fac.r and pos.e = fac.s - 1)",
)
PART_READS = "reads as (select row_number() over (order by q) r, q from (select distinct p_name q from part where p_name <> ''))"
DOCS = "docs as (select doc_id d, text t from documents)"
VOTES = "votes as (select id, d, cast(sum(e - s + 1) as bigint) w from (select id, s, e, unnest(ds) d from lst) group by id, d)"
TOP = "best as (select id, d, w, row_number() over (partition by id order by w desc, d) rnk from votes)"
TAXA = "taxa as (select item_id, r_name || ';' || n_name || ';' path from benchmark join nation on n_nationkey = item_id % 25 join region on r_regionkey = n_regionkey)"
TREE = "tree as (select r_name || ';' path, cast(r_regionkey as bigint) node_id, 'domain' as rank from region union all select r_name || ';' || n_name || ';', n_nationkey + 100, 'phylum' from nation join region on r_regionkey = n_regionkey union all select r_name || ';' || n_name || ';' || s_name || ';', s_suppkey + 1000, 'genus' from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey)"

DNA = "upper(regexp_replace(text, '[^ACGTacgt]', '', 'g'))"
FTAB = f"ft as (select distinct substr(q, p + 1, 10) kmer, item_id d from (select item_id, {DNA} q from benchmark), unnest(range(0, length(q) - 9)) as a(p))"
PROBE = f"k as (select doc_id, substr(q, p + 1, 10) kmer from (select doc_id, {DNA} q from documents), unnest(range(0, length(q) - 9)) as a(p))"

# minimizers, k = 4, w = 11
M64 = "18446744073709551616::uhugeint"


def _mix(h: str) -> str:
    return f"xor({h}, {h} >> 33)"


CODES = (
    "c0 as (select cast(i as ubigint) v, substr('ACGT', cast(i // 64 + 1 as int), 1) || substr('ACGT', cast(i // 16 % 4 + 1 as int), 1) || substr('ACGT', cast(i // 4 % 4 + 1 as int), 1) || substr('ACGT', cast(i % 4 + 1 as int), 1) m from range(256) t(i))",
    f"c1 as (select v, m, cast((cast({_mix('v')} as uhugeint) * 18397679294719823053::uhugeint) % {M64} as ubigint) h from c0)",
    f"c2 as (select v, m, cast((cast({_mix('h')} as uhugeint) * 14181476777654086739::uhugeint) % {M64} as ubigint) h from c1)",
    f"codes as (select v, m, {_mix('h')} h from c2)",
)


def _digest(order: str, unit: str, separator: str, short: str, rows: str = "(select doc_id, text from documents)") -> str:
    return _with(
        *CODES,
        f"s as (select doc_id, {DNA} q from {rows})",
        f"km as (select doc_id, p, codes.v, codes.m, codes.{order} o from s, unnest(range(0, length(q) - 3)) as a(p) join codes on codes.m = substr(q, p + 1, 4) where length(q) >= 11)",
        "win as (select doc_id, p, min(o) over x o, count(*) over x n from km window x as (partition by doc_id order by p rows between 7 preceding and current row))",
        "kept as (select doc_id, p, o from (select *, lag(o) over (partition by doc_id order by p) was from win where n = 8) where was is null or was <> o)",
        f"dig as (select doc_id, string_agg({unit}, '{separator}' order by p) d from kept join codes on codes.{order} = kept.o group by doc_id)",
        then=f"select s.doc_id, case when length(q) < 11 then {short} else d end as digest from s left join dig using (doc_id)",
    )


def _symbols(table: str, doc_id: str) -> str:
    """A character for each symbol of the minimizer alphabet."""
    return _digest("h", "chr(cast(19968 + case when codes.v <= 2 then codes.v + 3 else codes.v end as int))", "", "null", f"(select {doc_id} doc_id, text from {table})")


# index of supplier names by nation
SA = (
    "docs as (select s_nationkey, row_number() over (order by s_nationkey) - 1 d from (select distinct s_nationkey from supplier))",
    "seqs as (select s_suppkey sid, d, s_name q from supplier join docs using (s_nationkey))",
    "suf as (select sid, d, p, substr(q, p + 1) sfx, case when p = 0 then '$' else substr(q, p, 1) end ch from seqs, unnest(range(0, length(q) + 1)) as a(p))",
    "sa as (select row_number() over (order by sfx, sid, p) - 1 rw, * from suf)",
)
RUNS = (
    *SA,
    "fl as (select *, lag(ch) over (order by rw) is distinct from ch st, lead(ch) over (order by rw) is distinct from ch en from sa)",
    "rn as (select *, cast(sum(cast(st as int)) over (order by rw) as bigint) - 1 run_id from fl)",
)
RUN_TABLE = "runs as (select run_id, ch, count(*) len, row_number() over (partition by ch order by run_id) - 1 ch_rank from rn group by run_id, ch)"
LENS = (
    *RUNS,
    "bound as (select run_id, ch, ch || sfx longer, 'S' side from rn where st and ch <> '$' union all select run_id, ch, ch || sfx, 'E' from rn where en and ch <> '$')",
    "subs as (select distinct d, substr(sfx, 1, n) sub from suf, unnest(range(1, length(sfx) + 1)) as a(n))",
    "pre as (select distinct longer, n, substr(longer, 1, n) sub from bound, unnest(range(1, length(longer) + 1)) as a(n))",
    "best as (select longer, d, max(n) len from pre join subs using (sub) group by longer, d)",
    "full_ as (select x.longer, docs.d, coalesce(best.len, 0) len from (select distinct longer from bound) x cross join docs left join best on best.longer = x.longer and best.d = docs.d)",
    "rec as (select *, coalesce(max(len) over (partition by longer order by d rows between unbounded preceding and 1 preceding), 0) lm, coalesce(max(len) over (partition by longer order by d rows between 1 following and unbounded following), 0) rm, row_number() over (partition by longer order by len desc, d) k from full_)",
)


def _lens(*columns: str) -> str:
    return _with(*LENS, then=f"select run_id, ch, side, {', '.join(columns)} from bound join rec using (longer) group by run_id, ch, side, longer")


def _agg(value: str, order: str, where: str, name: str) -> str:
    return f"coalesce(string_agg({value}, ',' order by {order}) filter (where {where}), '') as {name}"


def _reads_listing(order: str, where: str) -> str:
    return _with(
        *FIRST,
        f"sets as (select f, {_agg('d', order, where, 'docs')} from rec group by f)",
        then="select p_partkey, cast(fac.ord as bigint) ord, fac.s, fac.e, coalesce(docs, '') docs from part join reads on q = p_name join fac using (r) left join hits using (r, ord) left join sets using (f)",
        recursive=True,
    )


PAIR = "d || ':' || len"
ORACLE: dict[str, str] = {
    "doc_listing_contains": f"select item_id, string_agg(doc_id, ',' order by doc_id) docs, count(*) n_docs from ({LISTED}) group by item_id",
    "doc_listing_by_lang": f"select item_id, string_agg(distinct lang, ',' order by lang) classes from ({LISTED}) group by item_id",
    "doc_listing_by_source": f"select item_id, string_agg(distinct source, ',' order by source) classes from ({LISTED}) group by item_id",
    "kmer_table": f"select kmer, count(*) n, count(distinct doc_id) n_docs from (select doc_id, substr(q, p + 1, 6) kmer from (select doc_id, {DNA} q from documents), unnest(range(0, length(q) - 5)) as a(p)) group by kmer",
    "ftab_kmers": _with(FTAB, then="select kmer, string_agg(d, ',' order by d) docs from ft group by kmer"),
    "ftab_probe_semi": _with(FTAB, PROBE, then="select doc_id, count(*) n, count(distinct kmer) n_kmers from k where kmer in (select kmer from ft) group by doc_id"),
    "ftab_probe_anti": _with(FTAB, PROBE, then="select doc_id, count(*) n, count(distinct kmer) n_kmers from k where kmer not in (select kmer from ft) group by doc_id"),
    "seed_islands": _with(*SEEDS, then="select r item_id, d doc_id, s, e, diag from isl"),
    "matching_statistics": _with(*SEEDS, SEED_MS, then="select r item_id, e, e - s + 1 as len from ms"),
    "maximal_match_listing": _with(*PARTS, then="select id p_partkey, cast(ord as bigint) ord, s, e, array_to_string(ds, ',') docs from lst", recursive=True),
    "seeded_match_listing": _with(*SEEDED, then="select fac.r item_id, cast(fac.ord as bigint) ord, fac.s, fac.e, coalesce(string_agg(d, ',' order by d), '') docs from fac left join inside using (r, ord) group by all", recursive=True),
    "indexed_match_listing": _with(*SEEDED, then="select fac.r item_id, cast(fac.ord as bigint) ord, fac.s, fac.e, coalesce(string_agg(d, ',' order by d), '') docs from fac left join inside using (r, ord) group by all", recursive=True),
    "exact_match_listing": _with(PART_READS, DOCS, *ANY, then="select p_partkey, cast(ord as bigint) ord, s, e, count(d) n_docs, min(d) first_doc, max(d) last_doc from part join reads on q = p_name join fac using (r) left join held using (f) group by all", recursive=True),
    "symbol_match_listing": _with(
        f"docs as (select doc_id d, coalesce(digest, '') t from ({_symbols('documents', 'doc_id')}))",
        f"reads as (select doc_id r, coalesce(digest, '') q from ({_symbols('benchmark', 'item_id')}))",
        *ANY,
        then="select r item_id, cast(ord as bigint) ord, s, e, count(d) n_docs, min(d) first_doc, max(d) last_doc from fac left join held using (f) group by all",
        recursive=True,
    ),
    "class_match_listing": _with(*SEEDED, "named as (select distinct r, ord, lang from inside join documents on doc_id = d)", then="select fac.r item_id, cast(fac.ord as bigint) ord, fac.s, fac.e, coalesce(string_agg(lang, ',' order by lang), '') classes from fac left join named using (r, ord) group by all", recursive=True),
    "run_tax_listing": _reads_listing("d", "len >= need and (len > lm or len > rm)"),
    "run_topk_listing": _reads_listing("k", "k <= 7 and len >= need"),
    "minimizer_digest_lex": _digest("v", "codes.m", "", "q"),
    "minimizer_digest_hash": _digest("h", "codes.m", "", "q"),
    "minimizer_digest_alphabet": _digest("h", "case when codes.v <= 2 then codes.v + 3 else codes.v end", ",", "null"),
    "revcomp": f"select doc_id, reverse(translate({DNA}, 'ACGT', 'TGCA')) seq from documents",
    "upper_complement": "select doc_id, translate(text, 'ACGTURYKMBDHVSWNabcdefghijklmnopqrstuvwxyz', 'TGCAAYRMKVHDBSWNTVGHEFCDIJMLKNOPQYSAABWXRZ') seq from documents",
    "suffix_lcp": _with(*SA, "two as (select *, lag(sfx) over (order by rw) was from sa)", then='select rw as "row", sid seq_id, d doc_id, p pos, ch, (select count(*) from range(1, 40) t(n) where n <= length(sfx) and n <= length(was) and substr(sfx, 1, n) = substr(was, 1, n)) lcp from two'),
    "bwt_runs": _with(*RUNS, RUN_TABLE, then="select run_id, ch, len, ch_rank from runs"),
    "run_counts": _with(*RUNS, RUN_TABLE, then="select ch, count(*) n_runs, cast(sum(len) as bigint) n from runs group by ch"),
    "f_column": _with(*SA, "n as (select ch, count(*) n from sa group by ch)", then='select ch, n, cast(coalesce(sum(n) over (order by ch rows between unbounded preceding and 1 preceding), 0) as bigint) as "first" from n'),
    "lf_mapping": _with(*SA, "n as (select ch, count(*) n from sa group by ch)", "f as (select ch, coalesce(sum(n) over (order by ch rows between unbounded preceding and 1 preceding), 0) b from n)", "x as (select rw, ch, row_number() over (partition by ch order by rw) - 1 rk from sa)", then='select rw as "row", ch, rk as "rank", cast(b + rk as bigint) lf from x join f using (ch)'),
    "doc_profile": _lens(_agg("len", "d", "true", "lens")),
    "profile_tax_compress": _lens(_agg(PAIR, "d", "len > lm", '"left"'), _agg(PAIR, "d desc", "len > rm", '"right"')),
    "profile_topk": _lens(_agg(PAIR, "k", "k <= 7", "top")),
    "profile_clip": _lens(_agg("least(len, 8)", "d", "true", "lens")),
    "profile_filter": _lens(_agg("d", "d", "len >= 4", "docs")),
    "tax_listing": _lens(_agg("d", "d", "len >= 4 and (len > lm or len > rm)", "docs")),
    "tax_endpoints": _lens("coalesce(case when min(d) filter (where len >= 4) = max(d) filter (where len >= 4) then cast(min(d) filter (where len >= 4) as varchar) else min(d) filter (where len >= 4) || ',' || max(d) filter (where len >= 4) end, '') as docs"),
    "topk_listing": _lens(_agg("d", "k", "k <= 7 and len >= 4", "docs")),
    "vote_top3": _with(*PARTS, VOTES, TOP, TAXA, then="select id p_partkey, rnk, d doc_id, path as label, w weight from best join taxa on item_id = d where rnk <= 3", recursive=True),
    "vote_lca": _with(
        *PARTS,
        "spans as (select id, list_min(ds) lo, list_max(ds) hi, e - s + 1 n from lst where len(ds) > 0)",
        "votes as (select id, d, round(sum(n / (hi - lo + 1)), 3) w from (select id, lo, hi, n, unnest(range(lo, hi + 1)) d from spans) where d in (select item_id from benchmark) group by id, d)",
        TOP,
        then="select id p_partkey, rnk, d doc_id, w weight from best where rnk <= 3",
        recursive=True,
    ),
    "mate_pair_vote": _with(
        *PARTS,
        "one as (select * from lst)",
        *(x.replace("reads", "reads2").replace("sub ", "sub2 ").replace("from sub", "from sub2").replace("sub22", "sub2").replace("held", "held2").replace("ms ", "ms2 ").replace("pos", "pos2").replace("fac", "fac2").replace("lst ", "two ") for x in _exact("p_type")),
        "votes as (select id, d, cast(sum(e - s + 1) as bigint) w from (select id, s, e, unnest(ds) d from (select * from one union all select * from two) where id in (select id from one) and id in (select id from two)) group by id, d)",
        TOP,
        then="select id p_partkey, rnk, d doc_id, w weight from best where rnk <= 3",
        recursive=True,
    ),
    "abundance_profile": _with(*PARTS, VOTES, TOP, TAXA, then="select path taxon, count(*) n from best join taxa on item_id = d where rnk = 1 group by path", recursive=True),
    "taxon_prefix_ranks": _with(TREE, then="select distinct a.path, b.path as prefix, b.rank as \"rank\", string_split(b.path, ';')[-2] as name from tree a join tree b on starts_with(a.path, b.path)"),
    "names_per_rank": _with(TREE, "x as (select distinct rank, string_split(path, ';')[-2] nm from tree)", then='select rank as "rank", count(*) n, string_agg(nm, \',\' order by nm) as names from x group by rank'),
    "level_name": _with(TREE, then="select node_id, string_split(path, ';')[-2] as name from tree"),
    "taxonomy_exact_join": _with(TREE, TAXA, then='select item_id doc_id, taxa.path, node_id, rank as "rank" from taxa join tree on tree.path = taxa.path'),
    "doc_lengths": "select lang, cast(sum(length(text)) as bigint) n_letters, count(*) n_docs from documents group by lang",
    "run_metrics": _with(*PARTS, then="select count(distinct id) reads, count(*) filter (where len(ds) > 0) matches, cast(coalesce(sum(e - s + 1) filter (where len(ds) > 0), 0) as bigint) matched, round(avg(e - s + 1) filter (where len(ds) > 0), 6) mean_length from lst", recursive=True),
    "vocabulary": "select ch, count(*) n_docs from (select distinct doc_id, unnest(string_split(text, '')) ch from documents) where ch <> '' group by ch",
    "dense_doc_check": "select count(distinct doc_id) n, max(doc_id) last, count(distinct doc_id) = max(doc_id) + 1 dense from documents",
    "file_list_validation": "select count(*) n, count(*) filter (where d not in (0, 1)) n_bad, min(doc_id) as \"first\" from (select doc_id, doc_id - lag(doc_id) over (order by doc_id) d from documents)",
    "listing_parse_roundtrip": _with(*PARTS, then="select id p_partkey, cast(ord as bigint) ord, s, e, array_to_string(ds, ',') docs from lst", recursive=True),
}
