"""SQL equivalents of the registered queries."""

from __future__ import annotations

_RAW = r"""
t as (select raw_id, fmt, regexp_replace(raw, '(\r\n|\n|\r)$', '') as r from raw_records),
b as (select raw_id, not regexp_full_match(r, '("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*') as bad_quote,
        regexp_extract_all(chr(9) || r, '\t("(?:[^"]|"")*"|[^"\t]*)', 1) as f from t where fmt = 'bed'),
c as (select raw_id, bad_quote,
        list_transform(f, lambda x: case when x like '"%' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as f from b),
q as (select raw_id, list_transform(split(r, chr(10)), lambda x: regexp_replace(x, '\r$', '')) as l from t where fmt = 'fastq'),
a as (select raw_id, f, case when bad_quote then 'quoting' when len(f) <> 8 then 'columns'
        when not (regexp_full_match(f[2], '[0-9]+') and regexp_full_match(f[3], '[0-9]+')) or not (f[3]::hugeint > f[2]::hugeint) then 'interval'
        when f[4] = '' then 'family' when not regexp_full_match(f[5], '[0-9]+') or f[5]::hugeint > 1000 then 'score'
        when f[6] not in ('+', '-', '.') then 'strand' when f[7] not in ('high', 'medium', 'low') then 'confidence' end as reason from c),
s as (select raw_id, l, case when len(l) <> 4 then 'lines' when not regexp_matches(l[1], '^@\s*\S') then 'header'
        when l[3] not like '+%' then 'separator' when not regexp_full_match(l[2], '[ACGTNacgtn]+') then 'base'
        when length(l[2]) <> length(l[4]) then 'length' end as reason from q)
"""

_READS = r"r as (select file_idx, rec_idx, id, upper(trim(sequence, E' \t\r\n')) as s, quality, description from reads)"
_TOP = "c as (select row_number() over (order by n desc, s) as i, s from (select s, count(*) as n from r where regexp_full_match(s, '[ACGT]+') group by s))"
_FAMILY = r"""f as (select *, 'TXF' || case when length(n) < 6 then lpad(n, 6, '0') else n end as fam from
        (select *, regexp_replace(digits, '^0+', '') as n from
            (select *, regexp_extract(family_id, '([0-9]+)[^0-9]*$', 1) as digits from families) where digits <> ''))"""
_RC = "translate(reverse({0}), 'ACGT', 'TGCA')"
_MOST = "greatest(" + ", ".join(f"length({{0}}) - length(replace({{0}}, '{b}', ''))" for b in "ACGT") + ")"
_TOO_PLAIN = f"({_MOST.format('{0}')} / length({{0}})::double >= 0.8 or len(list_distinct(list_transform(range(0, length({{0}}) - 1, 2), lambda i: substr({{0}}, i + 1, 2)))) <= 1)"
_RATIO = "round_even(length_ratio, 0)"
_ALIKE = "(local_identity >= 0.75 and local_overlap_fraction_shorter >= 0.75 and (kmer_jaccard >= 0.25 or shared_kmer_fraction >= 0.5))"
_STATUS = """case when coalesce(low_complexity_flag, false) and coalesce(regexp_matches(warning, '(^|;)possible_higher_order_or_partial:'), false) then 'low_complexity + related'
    when coalesce(regexp_matches(warning, '(^|;)possible_higher_order_or_partial:'), false) then 'related' when coalesce(low_complexity_flag, false) then 'low_complexity' else 'clean' end"""
_HITS = "h as (select * from array_hits where start_bp >= 0 and end_bp > start_bp)"
_REGIONS = r"""g as (select distinct probe_id, family_id, regexp_extract(x, '^(.*):([0-9]+)-([0-9]+)$', 1) as chrom, regexp_extract(x, '^(.*):([0-9]+)-([0-9]+)$', 2)::bigint as start_bp,
        regexp_extract(x, '^(.*):([0-9]+)-([0-9]+)$', 3)::bigint as end_bp from (select probe_id, family_id, unnest(split(predicted_regions, ';')) as x from probes where predicted_regions <> '') where regexp_matches(x, '^(.*):([0-9]+)-([0-9]+)$'))"""


#: The supported sequences as a catalog: every sequence of known bases with five reads, by rank.
_CATALOG = _TOP.replace("select row_number()", "select n, row_number()") + ", m as (select format('TXF{:06d}', i) as family_id, s from c where n >= 5)"
_SEEDS = f"""w as (select file_idx, rec_idx, length(s) as len, i - 1 as pos, substr(s, i::int, 11) as k
        from (select *, unnest(range(1, length(s) - 9)) as i from r where length(s) >= 11)),
v as (select file_idx, rec_idx, len, pos, least(k, {_RC.format("k")}) as k from w
        where regexp_full_match(k, '[ACGT]+') and {_MOST.format("k")} < 9
        and contains(k, 'A')::int + contains(k, 'C')::int + contains(k, 'G')::int + contains(k, 'T')::int > 2),
o as (select *, row_number() over (partition by file_idx, rec_idx, k order by pos) as j from v),
p as (select a.file_idx, a.rec_idx, a.len, a.k, b.pos - a.pos as d, row_number() over (partition by a.file_idx, a.rec_idx, a.k order by b.j - a.j, a.j) as seen
        from o a join o b on a.file_idx = b.file_idx and a.rec_idx = b.rec_idx and a.k = b.k and a.j < b.j where a.j <= 101 and b.j <= 101),
t as (select *, row_number() over (partition by file_idx, rec_idx, k order by seen) as taken from p where seen <= 2000 and d between 2 and least(2000, len // 2)),
h as (select file_idx, rec_idx, least(least(2000, len // 2), greatest(2, (d + 2) // 5 * 5)) as period_bp, count(*) as support from t where taken <= 100 group by all),
x as (select *, row_number() over (partition by file_idx, rec_idx order by support desc, period_bp) as peak from h where support >= 2)"""


def _same(table: str) -> str:
    """Identity of sequences with themselves shifted by p, from rows (file_idx, rec_idx, s, p); bases other than ACGT do not count."""
    return f"""select file_idx, rec_idx, p, case when known > 0 then equal::double / known else 0 end as v from (
        select file_idx, rec_idx, p, length(x) - hamming(x, replace(y, 'N', '#')) as equal,
            length(x) - hamming(regexp_replace(x, '[^N]', 'A', 'g'), replace(regexp_replace(y, '[^N]', 'A', 'g'), 'N', '#')) as known
        from (select file_idx, rec_idx, p, substr(n, 1, (length(n) - p)::int) as x, substr(n, (p + 1)::int) as y
            from (select file_idx, rec_idx, p, regexp_replace(s, '[^ACGT]', 'N', 'g') as n from {table})))"""


_SCAN = f"""{_READS}, {_SEEDS},
z as (select file_idx, rec_idx, s, length(s) as len from r where length(s) >= 40),
z1 as (select file_idx, rec_idx, s, unnest(range(2, least(19, len // 2) + 1)) as p from z),
z2 as ({_same("z1")}),
z3 as (select *, row_number() over (partition by file_idx, rec_idx order by v desc, p) as b from z2 where v > 0),
short as (select file_idx, rec_idx, p, v as score from z3 where b = 1 and v >= 0.8::double),
z4 as (select distinct file_idx, rec_idx, z.s, z.len, period_bp + d as p from z join x using (file_idx, rec_idx), unnest(range(-2, 3)) as u(d)
        where not exists (select 1 from short where short.file_idx = z.file_idx and short.rec_idx = z.rec_idx) and peak <= 5 and period_bp + d between 2 and least(2000, z.len // 2)),
z5 as ({_same("z4")}),
g as (select file_idx, rec_idx, k, list(pos order by pos) as spots, count(*) as n from o where j <= 101 group by all having count(*) >= 2),
g1 as (select *, row_number() over (partition by file_idx, rec_idx order by n desc, k) as place from g),
g2 as (select z5.file_idx, z5.rec_idx, p, k, v, n, list_transform(spots, lambda y: y % p) as q from z5 join g1 using (file_idx, rec_idx)
        where place <= 128 and v >= (0.75::double - 0.2::double) / 0.8::double),
g3 as (select file_idx, rec_idx, p, v, n, case when p <= 5 then n else list_max(list_transform(q, lambda y: len(list_filter(q, lambda y2: abs(y2 - y) <= 2)) + len(list_filter(q, lambda y2: y2 >= y + p - 2)))) end as held from g2),
g4 as (select file_idx, rec_idx, p, 0.2::double * (sum(held)::double / sum(n)::double) + 0.8::double * any_value(v) as score from g3 group by all),
g5 as (select *, row_number() over (partition by file_idx, rec_idx order by score desc, p) as b from g4),
every as (select file_idx, rec_idx, p, score from short union all select file_idx, rec_idx, p, score from g5 where b = 1 and score >= 0.75::double),
found as (select *, n <= 2 or {_MOST.format("monomer")} / n::double >= 0.8 or (n >= 4 and n % 2 = 0 and monomer = repeat(substr(monomer, 1, 2), (n // 2)::int)) as low
        from (select e.*, r.id, r.s, coalesce(r.description, '') as d, substr(r.s, 1, p::int) as monomer, length(substr(r.s, 1, p::int)) as n, length(r.s) as span from every e join r using (file_idx, rec_idx)))"""

_FAMILIES = f"""{_SCAN},
y0 as (select p, count(*) as n, row_number() over (order by p) as i from found group by p),
y1(i, p, cluster, total, n) as (select i, p, 0, p * n, n from y0 where i = 1
    union all select i, p, case when near then cluster else cluster + 1 end, case when near then total + p * n else p * n end, case when near then held + n else n end
    from (select y0.i, y0.p, y0.n, cluster, total, y1.n as held,
        abs(y0.p - round_even(total::double / y1.n, 0)) <= case when least(y0.p, round_even(total::double / y1.n, 0)) <= 19 then 0 else 5 end as near
        from y1 join y0 on y0.i = y1.i + 1)),
y2 as (select found.*, cluster, row_number() over (partition by cluster order by score desc, span desc, found.p, file_idx, rec_idx) as b from found join y1 using (p)),
y3 as (select cluster, count(distinct id) as support, sum(span)::bigint as span, avg(score) as score, bool_or(low) as low, round_even(avg(p), 0) as centre,
        max(case when b = 1 then monomer end) as monomer, max(case when b = 1 then p end) as p from y2 group by cluster having count(distinct id) >= 5),
fam as (select *, row_number() over (order by support desc, centre, cluster) as i, least(monomer, {_RC.format("monomer")}) as s from y3)"""


def _best_shift(pairs: str) -> str:
    """Best identity without gaps of x and y over all offsets with enough overlap, of rows (a, b, turn, x, y); none gives zeros."""
    return f"""select a, b, turn, case when share > 0 then share else 0 end as identity, case when share > 0 then n else 0 end as overlap from (
        select a, b, turn, share, n, row_number() over (partition by a, b, turn order by share desc, n desc, d) as place from (
            select a, b, turn, d, n, (n - hamming(substr(x, (greatest(0, d) + 1)::int, n::int), substr(y, (greatest(0, -d) + 1)::int, n::int)))::double / n as share from (
                select *, least(length(x) - greatest(0, d), length(y) - greatest(0, -d)) as n from (select *, unnest(range(1 - length(y), length(x))) as d from {pairs}))
            where n >= least(50, length(x), length(y)))) where place = 1"""


def _kmers(sequence: str, k: str) -> str:
    return f"list_distinct(list_filter(list_transform(range(1, (length({sequence}) - {k} + 2)::bigint), lambda j: substr({sequence}, j::int, ({k})::int)), lambda y: not contains(y, 'N')))"


#: Every sequence of the catalog with every monomer of the discovered families, in both orientations.
_MATCHES = f"""{_FAMILIES}, {_CATALOG},
q as (select format('TXM{{:06d}}', i) as known_id, s from fam),
q1 as (select family_id as a, known_id as b, turn, m.s as x, case when turn = 1 then {_RC.format("q.s")} else q.s end as y from m, q, (values (0), (1)) as t(turn)),
q2 as (select *, least(11, length(x), length(y)) as k from q1),
q3 as (select *, {_kmers("x", "k")} as kx, {_kmers("y", "k")} as ky from q2),
q4 as (select a, b, turn, x, y, len(list_intersect(kx, ky)) as shared, len(kx) as nx, len(ky) as ny from q3),
q5 as (select *, case when shared > 0 then 2.0::double * shared / (nx + ny) else 0 end as dice, case when shared > 0 then shared::double / nx else 0 end as in_x, case when shared > 0 then shared::double / ny else 0 end as in_y,
        case when shared > 0 then shared::double / least(nx, ny) else 0 end as share, case when shared > 0 then shared::double / (nx + ny - shared) else 0 end as jaccard from q4)"""

def _labels(most: int = 12, per_family: int = 3) -> str:
    """Pairs chosen one by one in order of score, no family in more than some of them, where they are more than all labels."""
    text = """p as (select distinct {'score': shared_kmer_fraction * local_identity * local_overlap_fraction_shorter * case when least(length_a_bp, length_b_bp) < 20 then 0.35::double else 1.0::double end,
        'share': shared_kmer_fraction, 'shorter': least(length_a_bp, length_b_bp), 'a': family_a, 'b': family_b} as r from family_similarity where relationship <> 'distinct' and family_a is not null and family_b is not null
        and shared_kmer_fraction is not null and local_identity is not null and local_overlap_fraction_shorter is not null),
c0 as (select 0::bigint as place, r from p where false)"""
    for i in range(1, most + 1):
        used = f"(select coalesce(sum(({{0}} = c.r.a)::int + ({{0}} = c.r.b)::int), 0) from c{i - 1} c) < (case when (select count(*) from p) <= {most} then {most} else {per_family} end)"
        text += f""",
c{i} as (select * from c{i - 1} union all (select {i}, max(r) from p where (not exists (select 1 from c{i - 1}) or r < (select min(r) from c{i - 1}))
        and {used.format("p.r.a")} and {used.format("p.r.b")} having max(r) is not null))"""
    return f"with {text}\nselect place::int as place, r.a as family_a, r.b as family_b, round(r.score, 6) as score from c{most}"


SQL = {
    "p2_found": """
with v as (select distinct chrom, family_id, start_bp as s, end_bp as e from array_hits
           where chrom is not null and family_id is not null and start_bp >= 0 and end_bp > start_bp),
w as (select *, max(e) over (partition by chrom, family_id order by s, e rows between unbounded preceding and 1 preceding) as m from v),
g as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by chrom, family_id order by s, e rows unbounded preceding) as i from w),
p as (select chrom, family_id, i, min(s) as s, max(e) as e from g group by all),
q as (select *, lag(e) over (partition by chrom, family_id order by s) as l from p)
select chrom, family_id, 'period' as kind, s as start_bp, e as end_bp from q
union all select chrom, family_id, 'gap', l, s from q where l is not null""",
    "p6_found": f"with {_RAW} select raw_id, reason from a where reason is not null union all select raw_id, reason from s where reason is not null",
    "p6_arrays": f"""
with {_RAW} select raw_id, f[1] as chrom, f[2]::bigint as start_bp, f[3]::bigint as end_bp, f[4] as family_id, f[5]::int as score,
    f[6] as strand, f[7] as confidence, f[8] as warning from a where reason is null""",
    "p6_reads": rf"""
with {_RAW}, h as (select *, trim(substr(l[1], 2)) as d from s where reason is null)
select raw_id, split(regexp_extract(d, '^\S+'), ';')[1] as id, upper(l[2]) as sequence, l[4] as quality, d as description from h""",
    "sequence_stats": """select file_idx, count(*) as record_count, sum(coalesce(length(sequence), 0))::bigint as total_bases,
    max(coalesce(length(sequence), 0)) as max_read_length from reads group by file_idx""",
    "length_summary": """
with l as (select length(sequence) as n, count(*) as c from reads where sequence is not null group by 1),
q as (select *, sum(n * c) over (order by n desc) as run, sum(n * c) over () as total from l)
select sum(c)::bigint as record_count, sum(n * c)::bigint as total_bases, min(n) as min_length, round(sum(n * c)::double / sum(c)::double, 6) as mean_length,
    max(n) as max_length, max(case when run >= (total + 1) // 2 then n end) as n50 from q""",
    "read_problems": f"""
with {_READS}
select r.file_idx, count_if(reads.sequence is null) as missing_sequence, count_if(coalesce(s = '', false)) as empty_sequence,
    count_if(coalesce(regexp_matches(s, '[^ACGTN]'), false)) as invalid_base, count_if(coalesce(length(s) <> length(r.quality), false)) as length_mismatch,
    count_if(coalesce(reads.sequence <> s, false)) as written_otherwise, count_if(coalesce(contains(s, 'N'), false)) as unknown_base
from r join reads using (file_idx, rec_idx) group by r.file_idx""",
    "duplicate_ids": "select id, count(*) as n_records from reads where id is not null group by id having count(*) > 1",
    "round_robin": "select file_idx, rec_idx, row_number() over (order by rec_idx, file_idx) as position from reads",
    "within_budget": """
with q as (select file_idx, rec_idx, coalesce(length(sequence), 0) as bases, row_number() over (order by file_idx, rec_idx) as position,
        sum(coalesce(length(sequence), 0)) over (order by file_idx, rec_idx)::bigint as total_bases from reads)
select * from q where total_bases <= (select round_even(sum(length(sequence)) * 0.4::double, 0) from reads)""",
    "hash_sample": f"select file_idx, rec_idx, id from reads where substr(md5(id), 1, 8) < '40000000'",
    "scan_counters": f"""
with {_READS}, {_SEEDS}, n as (select coalesce(length(s), 0) as n, s from r), e as (select count(*) as e from (select 1 from o group by file_idx, rec_idx, k having count(*) > 101))
select count(*) as n_reads, sum(n)::bigint as n_bases, count_if(s is null) as missing_sequence, count_if(n < 40) as short_for_span, 0::bigint as short_for_kmer, (select e from e) as overflowed_seeds from n""",
    "limited_reads": """
with q as (select file_idx, rec_idx, id, row_number() over (order by rec_idx, file_idx) as i, sum(coalesce(length(sequence), 0)) over (order by rec_idx, file_idx) as t from reads)
select file_idx, rec_idx, id from q where i <= 300 and t <= 20000""",
    "reverse_complements": f"""with {_READS}, q as (select *, {_RC.format("s")} as c from r)
select file_idx, rec_idx, c as reverse_complement, case when s is not null then least(s, c) end as oriented from q""",
    "base_composition": f"""
with {_READS}, q as (select *, length(s) as n, {_MOST.format("s")} as most, length(s) - length(translate(s, 'GC', '')) as gc,
        length(s) - length(translate(s, 'AT', '')) as weak from r where s is not null)
select file_idx, rec_idx, case when n > 0 then round(gc::double / n, 6) end as gc, (4.0 * gc + 2.0 * weak)::double as tm,
    case when n > 0 then round(most::double / n, 6) else 1.0 end as top_share,
    n <= 2 or most::double / n >= 0.8 or (n >= 4 and n % 2 = 0 and s = repeat(substr(s, 1, 2), (n // 2)::int)) as low from q""",
    "header_fields": r"""
select file_idx, rec_idx, split(split(trim(description), ' ')[1], ';')[1] as record_id,
    case when regexp_extract(';' || description, ';strand=([^;]*)', 1) in ('+', '-') then regexp_extract(';' || description, ';strand=([^;]*)', 1) else '.' end as strand,
    try_cast(regexp_extract(';' || description, ';source_start=([^;]*)', 1) as bigint) as source_start,
    try_cast(regexp_extract(';' || description, ';error_rate=([^;]*)', 1) as double) as error_rate from reads""",
    "sequence_files": rf"""
with {_READS}, q as (select *, coalesce(length(quality) = length(s), false) and not coalesce(regexp_matches(quality, '\s'), false) as good from r where regexp_full_match(s, '[ACGTN]+'))
select file_idx || ':' || rec_idx as id, s as sequence, case when good then quality end as quality, trim(file_idx || ':' || rec_idx || ' ' || coalesce(description, '')) as description from q""",
    "kmer_counts": f"""
with {_READS}, k as (select substr(s, i::int, 8) as k from (select s, unnest(range(1, length(s) - 6)) as i from r where length(s) >= 8))
select least(k, {_RC.format("k")}) as kmer, count(*) as n from k where regexp_full_match(k, '[ACGT]+') group by 1""",
    "kmer_spectrum": f"""
with {_READS}, k as (select substr(s, i::int, 21) as k from (select s, unnest(range(1, length(s) - 19)) as i from r where length(s) >= 21)),
c as (select least(k, {_RC.format("k")}) as kmer, count(*) as n from k where regexp_full_match(k, '[ACGT]+') group by 1)
select n as multiplicity, count(*) as kmers from c group by n""",
    "spacing_peaks": f"""
with {_READS}, {_SEEDS}
select file_idx, rec_idx, period_bp, support, peak from x where peak <= 5""",
    "discover_candidates": f"""
with {_SCAN}
select file_idx, rec_idx, id as read_id, 0::bigint as read_start, span as read_end,
    case when regexp_extract(';' || d, ';strand=([^;]*)', 1) in ('+', '-') then regexp_extract(';' || d, ';strand=([^;]*)', 1) else '.' end as strand,
    p as period_bp, span as repeat_span_bp, round(span::double / p, 6) as unit_count, round(score, 6) as score, low as low_complexity_flag,
    case when score >= 0.9 and not low then 'high' else 'medium' end as confidence,
    concat_ws(';', case when low then 'low_complexity_candidate' end, case when p <= 19 then 'short_period_candidate' end) as warning, monomer,
    format('TXC{{:06d}}', row_number() over (order by file_idx, rec_idx)) as candidate_id from found""",
    "discover_families": f"""
with recursive {_FAMILIES}
select format('TXF{{:06d}}', i) as family_id, format('TXM{{:06d}}', i) as monomer_id, s as monomer_sequence, p as monomer_length_bp, md5(s) as consensus_md5,
    round((length(s) - length(translate(s, 'GC', '')))::double / length(s), 6) as gc_fraction, support as support_read_count, span as support_span_bp, round(score, 6) as mean_identity, low as low_complexity_flag,
    case when support >= 5 and score >= 0.9 then 'high' else 'medium' end as confidence, case when low then 'low_complexity_family' else '' end as warning from fam""",
    "discover_similarity": f"""
with {_READS}, {_CATALOG},
k as (select distinct family_id, least(k, {_RC.format("k")}) as k from (select family_id, substr(s, i::int, 11) as k from (select *, unnest(range(1, length(s) - 9)) as i from m where length(s) >= 11))),
n as (select family_id, count(*) as n from k group by family_id),
h as (select x.family_id as a, y.family_id as b, count(*) as shared from k x join k y on x.k = y.k and x.family_id < y.family_id group by all),
p as (select a, b, turn, mx.s as x, case when turn = 1 then {_RC.format("my.s")} else my.s end as y from h join m mx on mx.family_id = a join m my on my.family_id = b, (values (0), (1)) as t(turn)),
l as ({_best_shift("p")}),
l1 as (select *, row_number() over (partition by a, b order by identity desc, overlap desc, turn) as place from l),
z as (select a as family_a, b as family_b, length(mx.s) as length_a_bp, length(my.s) as length_b_bp, shared::double / (nx.n + ny.n - shared) as kmer_jaccard, shared::double / least(nx.n, ny.n) as shared_kmer_fraction,
    identity as local_identity, overlap as local_overlap_bp, overlap::double / least(length(mx.s), length(my.s)) as local_overlap_fraction_shorter,
    greatest(length(mx.s), length(my.s))::double / least(length(mx.s), length(my.s)) as length_ratio, case when turn = 1 then 'reverse' else 'forward' end as orientation
    from h join l1 using (a, b) join m mx on mx.family_id = a join m my on my.family_id = b join n nx on nx.family_id = a join n ny on ny.family_id = b where place = 1),
y as (select *, case when abs(length_ratio - {_RATIO}) <= 0.05::double and {_RATIO} >= 2 and {_ALIKE} then 'possible_higher_order_or_partial'
    when local_identity >= 0.9::double and local_overlap_fraction_shorter >= 0.85::double and shared_kmer_fraction >= 0.8::double and length_ratio <= 1.2::double then 'likely_redundant'
    when {_ALIKE} then 'possible_higher_order_or_partial' else 'distinct' end as relationship from z)
select family_a, family_b, length_a_bp, length_b_bp, kmer_jaccard, shared_kmer_fraction, local_identity, local_overlap_bp,
    local_overlap_fraction_shorter, length_ratio, orientation, relationship, relationship = 'likely_redundant' as redundant_candidate from y""",
    "short_periods": f"""
with {_READS}, p as (select file_idx, rec_idx, s, unnest(range(2, least(19, length(s) // 2) + 1)) as p from r where length(s) >= 4),
c as (select file_idx, rec_idx, p, substr(s, i::int, 1) as x, substr(s, (i + p)::int, 1) as y from (select *, unnest(range(1, length(s) - p + 1)) as i from p)),
q as (select file_idx, rec_idx, p, case when count_if(x in ('A', 'C', 'G', 'T') and y in ('A', 'C', 'G', 'T')) = 0 then 0
        else count_if(x = y and x in ('A', 'C', 'G', 'T'))::double / count_if(x in ('A', 'C', 'G', 'T') and y in ('A', 'C', 'G', 'T')) end as v from c group by all),
b as (select file_idx, rec_idx, p, v, row_number() over (partition by file_idx, rec_idx order by v desc, p) as k from q where v > 0)
select r.file_idx, r.rec_idx, coalesce(p, 0) as period_bp, round(coalesce(v, 0), 6) as identity from r left join (select * from b where k = 1) b using (file_idx, rec_idx)""",
    "copy_number": f"""
with {_READS}, {_CATALOG},
k as (select family_id, substr(s, i::int, 21) as k from (select *, unnest(range(1, length(s) - 19)) as i from m where length(s) >= 21)),
mk as (select family_id, least(k, {_RC.format("k")}) as kmer, count(*) as multiplicity from k group by all),
d as (select kmer, min(family_id) as family_id, min(multiplicity) as multiplicity from mk group by kmer having count(*) = 1 and not {_TOO_PLAIN.format("kmer")}),
rk as (select substr(s, i::int, 21) as k from (select s, unnest(range(1, length(s) - 19)) as i from r where length(s) >= 21)),
n as (select least(k, {_RC.format("k")}) as kmer, count(*) as n from rk where regexp_full_match(k, '[ACGT]+') group by 1),
x as (select family_id, count(*) as d, median(coalesce(n, 0)::double / multiplicity) as m from d left join n using (kmer) group by family_id),
g as (select sum(length(s))::double / 1000000.0::double as depth from r),
y as (select m.family_id, length(s) as monomer_length, coalesce(d, 0) as d, coalesce(x.m, 0.0) as md, depth from m left join x using (family_id), g)
select family_id, monomer_length, d as diagnostic_kmer_count, round(md, 6) as median_kmer_depth, round(depth, 6) as haploid_depth,
    round(md / depth, 6) as estimated_copy_number, round(md / depth * monomer_length, 6) as estimated_bp, case when d = 0 then 'low' else 'medium' end as confidence,
    'haploid_depth_estimated_from_total_read_bases_and_genome_size' || case when d = 0 then ';no_diagnostic_kmers' else '' end as warning from y""",
    "locate_arrays": f"""
with {_READS}, {_CATALOG},
k as (select family_id, substr(s, i::int, 21) as k from (select *, unnest(range(1, length(s) - 19)) as i from m where length(s) >= 21)),
mk as (select distinct family_id, least(k, {_RC.format("k")}) as kmer from k),
mk2 as (select * from mk where not {_TOO_PLAIN.format("kmer")}),
w as (select file_idx || ':' || rec_idx as chrom, i - 1 as pos, substr(s, i::int, 21) as k from (select *, unnest(range(1, length(s) - 19)) as i from r where length(s) >= 21)),
h as (select chrom, family_id, pos as s, pos + 21 as e from w join mk2 on mk2.kmer = least(k, {_RC.format("k")}) where regexp_full_match(k, '[ACGT]+')),
a as (select *, max(e) over (partition by chrom, family_id order by s rows between unbounded preceding and 1 preceding) as m from h),
b as (select *, sum(case when m is null or s > m + 42 then 1 else 0 end) over (partition by chrom, family_id order by s rows unbounded preceding) as g from a),
x as (select chrom, family_id, min(s) as start_bp, max(e) as end_bp, count(*) as n from b group by chrom, family_id, g),
z as (select x.*, least(1000, (1000 * n) // greatest(1, end_bp - start_bp - 20))::int as score from x join m using (family_id) where end_bp - start_bp >= greatest(length(m.s) // 2, 42))
select chrom, start_bp, end_bp, family_id, score, '.' as strand, case when score >= 500 then 'high' else 'medium' end as confidence, '' as warning from z""",
    "merged_hits": f"""
with {_HITS}, a as (select chrom, family_id, start_bp as s, end_bp as e, max(end_bp) over (partition by chrom, family_id order by start_bp, end_bp, hit_id rows between unbounded preceding and 1 preceding) as m, hit_id
        from h where chrom is not null and family_id is not null),
b as (select *, sum(case when m is null or s > m + 1000 then 1 else 0 end) over (partition by chrom, family_id order by s, e, hit_id rows unbounded preceding) as g from a)
select chrom, family_id, min(s) as start_bp, max(e) as end_bp, count(*) as hit_count from b group by chrom, family_id, g""",
    "window_density": f"""
with {_HITS}, l as (select chrom, max(end_bp) as n from h where chrom is not null group by chrom),
w as (select chrom, n, unnest(range(0, (case when n > 100000 then ceil((n - 100000) / 10000.0)::bigint * 10000 else 0 end) + 1, 10000)) as w from l),
t as (select chrom, start_bp as s, end_bp as e, unnest(range(greatest(0, (floor((start_bp - 100000) / 10000.0)::bigint + 1) * 10000), (end_bp - 1) // 10000 * 10000 + 1, 10000)) as w from h where chrom is not null),
c as (select chrom, w, sum(least(e, w + 100000) - greatest(s, w)) as c from t group by chrom, w)
select w.chrom, w.w as start_bp, least(n, w.w + 100000) as end_bp, round(coalesce(c, 0)::double / (least(n, w.w + 100000) - w.w)::double, 6) as density from w left join c using (chrom, w)""",
    "assembly_vs_reads": f"""
with {_HITS}, {_FAMILY}, a as (select family_id, sum(end_bp - start_bp)::double as a from h where family_id is not null group by family_id),
q as (select fam as family_id, sum(support_span_bp)::double as r from f where support_span_bp >= 1 group by fam),
b as (select family_id, coalesce(r, 0) as r, coalesce(a, 0) as a from a full join q using (family_id))
select family_id, r as read_estimated_bp, a as assembly_estimated_bp, case when r > 0 then round(a / r, 6) else 0.0 end as assembly_read_ratio,
    case when r <= 0 and a <= 0 then 'low_confidence' when r <= 0 then 'assembly_only' when a <= 0 then 'reads_only' when a / r < 0.6::double then 'possible_collapse'
        when a / r > 1.5::double then 'possible_overexpansion' else 'consistent' end as status,
    case when r <= 0 then 'low' else 'medium' end as confidence,
    case when r <= 0 and a <= 0 then 'missing_read_and_assembly_estimates' when r <= 0 then 'missing_read_estimate' when a <= 0 then 'missing_assembly_array' else '' end as warning from b""",
    "probe_ranking": """
with q as (select probe_id, family_id, least(1.0::double, coalesce(estimated_copy_number, 0) / 10.0::double) * specificity_score * greatest(arrayiness_score, 0.1::double) * greatest(0.0::double, 1.0::double - abs(gc_content - 0.5::double)) as score
        from probes where family_id is not null and probe_id is not null and specificity_score is not null and arrayiness_score is not null and gc_content is not null),
o as (select probe_id, family_id, max(score) as score from q group by all)
select *, row_number() over (order by score desc, family_id, probe_id) as position from o""",
    "fish_signals": f"with {_REGIONS}, m as (select probe_id, max(case when isfinite(probe_score) then probe_score end) as predicted_signal from probes group by probe_id) select g.*, predicted_signal from g join m using (probe_id)",
    "probes_on_target": f"""with {_REGIONS} select * from g where family_id is not null and end_bp > start_bp and exists
    (select 1 from array_hits a where a.chrom = g.chrom and a.family_id = g.family_id and a.start_bp >= 0 and a.end_bp > a.start_bp and g.start_bp < a.end_bp and a.start_bp < g.end_bp)""",
    "best_probe_scores": """select family_id, max(probe_score) as max_probe_score, arg_max_null(estimated_copy_number, {'a': loaded_at, 'b': probe_id}) as last_copy_number
    from probes where family_id is not null and isfinite(probe_score) group by family_id""",
    "pair_classes": f"""select relationship, redundant_candidate, case when abs(length_ratio - {_RATIO}) <= 0.05::double and {_RATIO} >= 2 and {_ALIKE} then 'possible_higher_order_or_partial'
    when local_identity >= 0.9::double and local_overlap_fraction_shorter >= 0.85::double and shared_kmer_fraction >= 0.8::double and length_ratio <= 1.2::double then 'likely_redundant'
    when {_ALIKE} then 'possible_higher_order_or_partial' else 'distinct' end as recomputed, count(*) as n from family_similarity group by all""",
    "redundancy_warnings": """select distinct unnest([family_a, family_b]) as family_id, relationship || ':' || family_a || '-' || family_b as warning
    from family_similarity where relationship <> 'distinct' and family_a is not null and family_b is not null""",
    "collapse_families": f"""
with recursive {_FAMILY}, l as (select * from (select *, row_number() over (partition by fam order by record_id desc) as k from f) where k = 1),
e as (select family_a as a, family_b as b from family_similarity where relationship = 'likely_redundant' and family_a <> family_b),
d as (select a, b from e union select b, a from e),
r(x, y) as (select distinct a, a from d union select d.b, r.y from r join d on d.a = r.x),
g as (select x, min(y) as y from r group by x),
c as (select l.fam, coalesce(g.y, l.fam) as comp, l.support_read_count, l.support_span_bp, l.mean_identity, l.monomer_length_bp from l left join g on g.x = l.fam),
b as (select *, first_value(fam) over w as kept, count(*) over (partition by comp) as n from c window w as (partition by comp
    order by support_read_count desc nulls last, support_span_bp desc nulls last, mean_identity desc nulls last, monomer_length_bp nulls last, fam desc)),
z as (select least(family_a, family_b) as x, greatest(family_a, family_b) as y, max({{'a': kmer_jaccard, 'b': shared_kmer_fraction, 'c': local_identity, 'd': local_overlap_bp, 'e': length_ratio}}) as f
        from family_similarity where relationship = 'likely_redundant' and family_a <> family_b group by all),
z1 as (select x, y, concat_ws(';', 'kmer_jaccard=' || printf('%.4f', f.a), 'shared_kmer_fraction=' || printf('%.4f', f.b), 'local_identity=' || printf('%.4f', f.c), 'local_overlap_bp=' || f.d, 'length_ratio=' || printf('%.4f', f.e)) as m from z)
select fam as original_family_id, kept as retained_family_id, case when fam = kept then 'retained' else 'collapsed' end as action,
    case when fam <> kept then 'likely_redundant_to_retained_family' when n > 1 then 'selected_representative' else 'no_likely_redundant_match' end as reason,
    case when fam = kept then '' else 'likely_redundant' end as relationship, case when fam = kept then '' else coalesce(m, '') end as similarity_metrics,
    case when fam = kept then 'only redundant families collapse' when m is null then 'linked through others' else '' end as notes
from b left join z1 on z1.x = least(fam, kept) and z1.y = greatest(fam, kept)""",
    "catalog_summary": """
with t as (select record_id, support_span_bp from families where support_span_bp is not null order by support_span_bp desc, record_id desc limit 1)
select count(*) as family_count, count_if(low_complexity_flag) as low_complexity_count, count_if(warning <> '') as warning_count, median(monomer_length_bp)::double as median_length_bp,
    sum(greatest(0, support_read_count))::bigint as total_support_reads, sum(greatest(0, support_span_bp))::bigint as total_support_bp,
    (select count_if(relationship <> 'distinct') from family_similarity) as non_distinct_pair_count,
    (select record_id from t) as top_record_id, (select support_span_bp from t) as top_span_bp from families""",
    "label_counts": f"""
with s as (select confidence, warning, {_STATUS} as status from families),
u as (select 'confidence' as column_name, confidence as v from s union all select 'status', status from s union all select 'warning', warning from s)
select column_name, case when coalesce(v, '') = '' then 'empty' else v end as label, count(*) as n from u group by all""",
    "warning_counts": """
with u as (select 'families' as source, warning from families union all select 'array_hits', warning from array_hits union all select 'probes', warning from probes),
x as (select source, unnest(split(warning, ';')) as warning from u where warning <> '')
select source, warning, count(*) as n from x where warning <> '' group by all""",
    "length_histogram": """select floor(monomer_length_bp / 25.0)::bigint * 25 as bin_start, count(*) as n, sum(greatest(0, support_span_bp))::bigint as total_weight
    from families where monomer_length_bp is not null group by 1""",
    "top_families": f"select record_id, family_id, support_span_bp, {_STATUS} as status from families order by support_span_bp desc nulls last, record_id limit 20",
    "flag_accuracy": """
with a as (select run_id, count_if(redundant_candidate) as positive, count_if(relationship = 'likely_redundant') as predicted,
        count_if(relationship = 'likely_redundant' and redundant_candidate) as correct, count_if(not redundant_candidate) as background
        from family_similarity where redundant_candidate is not null and relationship is not null group by run_id)
select run_id, positive, predicted, correct, case when positive > 0 then round(correct::double / positive, 6) else 0.0 end as recall,
    case when predicted > 0 then round(correct::double / predicted, 6) else 0.0 end as precision,
    case when background > 0 then round((predicted - correct)::double / background, 6) else 0.0 end as false_positive_rate from a""",
    "nearest_lengths": """
with t as (select distinct monomer_length_bp as n from families where monomer_length_bp is not null),
r as (select distinct length_a_bp as m from family_similarity where redundant_candidate and length_a_bp is not null),
x as (select n, m, row_number() over (partition by n order by abs(m - n), m) as k from t, r)
select n as true_length, m as nearest_length, abs(m - n) as length_error_bp from x where k = 1""",
    "run_differences": """
with a as (select run_id as run, max(low_complexity_flag)::varchar as any_low, max(warning) as top_warning, count(*)::varchar as records from families group by run_id),
u as (select run, 'any_low' as item, any_low as v from a union all select run, 'top_warning', top_warning from a union all select run, 'records', records from a)
select x.run as run_a, y.run as run_b, item, x.v as value_a, y.v as value_b, x.v is not distinct from y.v as same from u x join u y using (item) where y.run = x.run + 1""",
    "run_comparison": """
with f as (select run_id as run, count(*) as records, count(distinct monomer_length_bp) as lengths from families group by 1),
s as (select run_id as run, 'setting' as category, 'backend' as item, backend as v, true as blocking from runs union all select run_id, 'setting', 'kmer_size', kmer_size::varchar, true from runs
    union all select run, 'result', 'records', records::varchar, false from f union all select run, 'result', 'lengths', lengths::varchar, false from f),
p as (select x.run_id as run_a, y.run_id as run_b from runs x join runs y on y.run_id = x.run_id + 1),
a as (select run_a, run_b, s.* from p join s on s.run = run_a), b as (select run_a, run_b, s.* from p join s on s.run = run_b),
r as (select run_a, run_b, category, item, coalesce(a.v, '') as value_a, coalesce(b.v, '') as value_b, a.v is not distinct from b.v as same,
        case when coalesce(a.blocking, b.blocking) then 'blocking_if_different' else 'result_difference' end as impact, '' as notes from a full join b using (run_a, run_b, category, item)),
t as (select run_a, run_b, coalesce(string_agg(item || ': ' || value_a || ' vs ' || value_b, '; ' order by item) filter (where impact = 'blocking_if_different' and not same), '') as why from r group by all)
select * from r union all select run_a, run_b, 'interpretation', 'directly_comparable', (why = '')::varchar, (why = '')::varchar, true, 'summary', why from t""",
    "period_accuracy": f"""
with {_SCAN}, u0 as (select r.file_idx, r.rec_idx, p as true_period from r left join found using (file_idx, rec_idx)),
u1 as (select u0.file_idx, u0.rec_idx, true_period, count(period_bp) as made, min(abs(period_bp - true_period)) as error from u0 left join (select * from x where peak <= 5) x using (file_idx, rec_idx) group by all),
u2 as (select count(true_period) as positive_reads, count_if(made > 0) as predicted_reads, count_if(coalesce(error <= greatest(2, round_even(true_period * 0.02::double, 0)), false)) as correct_reads,
        count_if(made > 0 and true_period is null) as false_positive_reads, count_if(true_period is null) as background, avg(error) as e from u1)
select positive_reads, predicted_reads, correct_reads, false_positive_reads, round(correct_reads::double / positive_reads, 6) as recall, round(correct_reads::double / predicted_reads, 6) as precision,
    round(false_positive_reads::double / background, 6) as false_positive_rate, round(e, 6) as period_error_bp from u2""",
    "run_aggregate": """select backend, kmer_size, count(*) as n, median(monomer_length_bp)::double as median_length_bp,
    round(avg(case when mean_identity >= 0 and mean_identity <= 1 and not isnan(mean_identity) then mean_identity end), 6) as mean_identity,
    count_if(confidence = 'high') as high_confidence from families join runs using (run_id) group by all""",
    "failed_checks": """
with a as (select count(*) as n_rows, count_if(not coalesce(end_bp > start_bp, false)) as half_open, count_if(not coalesce(start_bp >= 0, false)) as not_negative,
        count_if(not coalesce(score between 0 and 1000, false)) as score_range, count_if(not coalesce(strand in ('+', '-', '.'), false)) as strand,
        count_if(not coalesce(confidence <> '', false)) as confidence, count_if(not coalesce(family_id <> '', false)) as family from array_hits)
select 'half_open' as check_name, half_open as n_failed, n_rows from a union all select 'not_negative', not_negative, n_rows from a
union all select 'score_range', score_range, n_rows from a union all select 'strand', strand, n_rows from a
union all select 'confidence', confidence, n_rows from a union all select 'family', family, n_rows from a""",
    "known_matches": f"""
with recursive {_MATCHES},
best as (select *, row_number() over (partition by b order by dice desc, in_y desc, a, turn) as place from q5 where shared > 0)
select known_id as known_repeat_id, length(q.s) as known_repeat_length, best.a as best_family_id, length(best.x) as best_monomer_length, round(coalesce(dice, 0), 6) as similarity_score,
    round(coalesce(in_y, 0), 6) as shared_kmer_fraction, case turn when 0 then 'forward' when 1 then 'reverse' end as orientation,
    case when coalesce(dice, 0) >= 0.8 then 'strong_post_hoc_match' when coalesce(dice, 0) >= 0.5 then 'possible_post_hoc_match' when coalesce(dice, 0) > 0 then 'weak_post_hoc_match' else 'no_kmer_match' end as interpretation
from q left join (select * from best where place = 1) best on best.b = known_id""",
    "annotate_repeats": f"""
with recursive {_MATCHES},
a0 as ({_best_shift("q1")}),
a1 as (select *, greatest(in_x, in_y) as inside, row_number() over (partition by a order by dice desc, greatest(in_x, in_y) desc, identity desc, overlap desc, b, turn) as place from q5 join a0 using (a, b, turn)),
a2 as (select *, greatest(1, least(length(x), length(y))) as shorter, greatest(length(x), length(y))::double / greatest(1, least(length(x), length(y))) as ratio from a1 where place = 1),
a3 as (select *, case when dice = 0 and identity < 0.5 then 'no_known_match' when dice >= 0.8 and identity >= 0.8 then 'strong_known_match'
    when abs(ratio - round_even(ratio, 0)) <= 0.10::double and round_even(ratio, 0) >= 2 and inside >= 0.65 and identity >= 0.70 then 'possible_higher_order_match'
    when inside >= 0.5 and overlap::double / shorter >= 0.5 then 'possible_partial_match' when dice >= 0.2 or identity >= 0.65 then 'weak_known_match' else 'no_known_match' end as annotation_status from a2)
select a as family_id, length(x) as monomer_length, case when dice > 0 or annotation_status <> 'no_known_match' then b end as best_known_id, length(y) as best_known_length,
    case turn when 0 then 'forward' else 'reverse' end as best_orientation, round(share, 6) as shared_kmer_fraction, round(jaccard, 6) as jaccard, round(dice, 6) as dice,
    round(in_x, 6) as containment_discovered_in_known, round(in_y, 6) as containment_known_in_discovered, round(identity, 6) as local_identity, overlap as local_overlap_bp, annotation_status, b as nearest_known_id from a3""",
    "label_pairs": _labels(),
}
