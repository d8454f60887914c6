"""DuckDB SQL with the results of the queries, over the supplied tables."""

from __future__ import annotations

EPS = "2.220446049250313e-16"

#: Loci, pools and alleles: counts with zeros filled in (c), phenotypes (p, y), in order of labels (a).
BASE = """
WITH RECURSIVE g AS (
  SELECT concat('chr', CAST(l_partkey % 5 AS VARCHAR)) AS chr, l_partkey AS pos, n_regionkey AS pool_idx,
         CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'A' WHEN 'AO' THEN 'T' WHEN 'NF' THEN 'C' WHEN 'NO' THEN 'G' WHEN 'RF' THEN 'D' WHEN 'RO' THEN 'N' END AS allele,
         count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4
), a(allele, ord) AS (VALUES ('A', 0), ('T', 1), ('C', 2), ('G', 3), ('D', 4), ('N', 5)),
p AS (
  SELECT n_regionkey AS pool_idx, count(*) AS size, round(avg(c_acctbal), 6) AS trait0 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
), p1 AS (
  SELECT n_regionkey AS pool_idx, round(avg(o_totalprice), 6) AS trait1 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
), y AS (
  SELECT pool_idx, 'Pheno_0' AS phenotype, trait0 AS y FROM p UNION ALL SELECT pool_idx, 'Pheno_1', trait1 FROM p1
), c AS (
  SELECT l.chr, l.pos, p.pool_idx, a.allele, a.ord, coalesce(g.n, 0) AS n
  FROM (SELECT DISTINCT chr, pos FROM g) l CROSS JOIN p CROSS JOIN a LEFT JOIN g ON g.chr = l.chr AND g.pos = l.pos AND g.pool_idx = p.pool_idx AND g.allele = a.allele
)"""


def filtered(depth: int = 1, maf: float = 0.001, missing: float = 0.0) -> str:
    """CTEs up to ``f``: what the filter lets pass, with coverage cv and freq."""
    return BASE + f""", n0 AS (
  SELECT *, sum(n) OVER (PARTITION BY chr, pos, pool_idx) AS cov FROM c WHERE allele <> 'N'
), n1 AS (
  SELECT *, min(cov) OVER (PARTITION BY chr, pos) AS least, avg(CASE WHEN cov = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY chr, pos) AS gone FROM n0
), n2 AS (SELECT n1.*, p.size FROM n1 JOIN p USING (pool_idx) WHERE least >= {depth}),
q AS (
  SELECT *, sum(coalesce(n / nullif(cov, 0), 0) * size) OVER (PARTITION BY chr, pos, allele) / sum(size) OVER (PARTITION BY chr, pos, allele) AS qa FROM n2
), k AS (SELECT * FROM q WHERE qa BETWEEN {maf} AND 1 - {maf}),
k2 AS (SELECT *, count(*) OVER (PARTITION BY chr, pos, pool_idx) AS na FROM k),
f0 AS (SELECT *, sum(n) OVER (PARTITION BY chr, pos, pool_idx) AS cv FROM k2 WHERE na >= 2 AND gone <= {missing} AND gone < 1),
f AS MATERIALIZED (SELECT chr, pos, pool_idx, allele, ord, n, cv, size, n / nullif(cv, 0) AS freq FROM f0)"""


#: Chain of windows of 100 bp each 50 bp with 10 loci at least, as w (chr, pos_ini, pos_fin, n_loci).
WINDOWS = """, l AS (SELECT DISTINCT chr, pos FROM f),
o AS MATERIALIZED (SELECT chr, pos, row_number() OVER (ORDER BY chr, pos) - 1 AS i FROM l),
z AS MATERIALIZED (
  SELECT *, max(i) OVER (PARTITION BY chr ORDER BY pos RANGE BETWEEN CURRENT ROW AND 100 FOLLOWING) AS t,
         min(i) OVER (PARTITION BY chr ORDER BY pos RANGE BETWEEN 50 FOLLOWING AND 100 FOLLOWING) AS nx FROM o
), chain AS (
  SELECT i, t, coalesce(nx, t + 1) AS nx, 1 AS k FROM z WHERE i = 0
  UNION ALL SELECT z.i, z.t, coalesce(z.nx, z.t + 1), chain.k + 1 FROM chain JOIN z ON z.i = chain.nx WHERE chain.t < (SELECT max(i) FROM o)
), ch AS (
  SELECT *, t - i + 1 AS n, lag(t - i + 1) OVER (ORDER BY k) AS before, max(k) OVER () AS top FROM chain
), kept AS MATERIALIZED (SELECT * FROM ch WHERE n >= 10 OR (k = top AND (n > 1 OR before IS NULL OR before >= 10))),
kept2 AS MATERIALIZED (SELECT *, lag(t) OVER (ORDER BY k) AS lt FROM kept),
w AS MATERIALIZED (
  SELECT s.chr, s.pos AS pos_ini, e.pos AS pos_fin, n AS n_loci FROM kept2 JOIN o s ON s.i = kept2.i JOIN o e ON e.i = kept2.t WHERE lt IS NULL OR lt <> t
)"""

_PI = f""", x AS MATERIALIZED (
  SELECT chr, pos, pool_idx, abs((sum(freq * freq) - 1) * (max(cv) / (max(cv) - 1 + {EPS}))) AS pi, CASE WHEN max(freq) < 1 THEN 1 ELSE 0 END AS poly FROM f GROUP BY 1, 2, 3
)"""

_FST = f""", own AS (
  SELECT chr, pos, pool_idx, 1 - (1 - sum(freq * freq)) * (max(cv) / (max(cv) - 1 + {EPS})) AS q FROM f GROUP BY 1, 2, 3
), across AS (
  SELECT u.chr, u.pos, u.pool_idx AS pool_a, v.pool_idx AS pool_b, sum(u.freq * v.freq) AS q FROM f u JOIN f v ON u.chr = v.chr AND u.pos = v.pos AND u.allele = v.allele AND u.pool_idx <= v.pool_idx GROUP BY 1, 2, 3, 4
), fst AS MATERIALIZED (
  SELECT across.chr, across.pos, pool_a, pool_b, least(1.0, greatest(0.0, ((u.q + v.q) / 2 - across.q) / (1 - across.q + {EPS}))) AS fst
  FROM across JOIN own u ON u.chr = across.chr AND u.pos = across.pos AND u.pool_idx = pool_a JOIN own v ON v.chr = across.chr AND v.pos = across.pos AND v.pool_idx = pool_b
)"""

_IN = "JOIN w ON w.chr = {0}.chr AND {0}.pos BETWEEN w.pos_ini AND w.pos_fin"

_TAJIMA = f""", h AS (
  SELECT pool_idx, size AS n, list_sum(list_transform(range(1, size), lambda i: 1.0 / i)) AS a1, list_sum(list_transform(range(1, size), lambda i: 1.0 / (i * i))) AS a2 FROM p
), e AS (
  SELECT pool_idx, a1, ((n + 1) / (3.0 * (n - 1)) - 1 / a1) / a1 AS e1, (2.0 * (n * n + n + 3) / (9.0 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM h
), m AS MATERIALIZED (
  SELECT w.chr, pos_ini, pos_fin, pool_idx, CASE WHEN count(pi) = count(*) THEN avg(pi) END AS pi, sum(poly) / count(*) AS share FROM x {_IN.format('x')} GROUP BY 1, 2, 3, 4
), td0 AS (SELECT m.*, share / a1 AS theta_w, share / a1 / a1 AS s, e1, e2 FROM m JOIN e USING (pool_idx)),
td AS MATERIALIZED (
  SELECT chr, pos_ini, pos_fin, pool_idx, pi, theta_w,
         CASE WHEN abs(pi - theta_w) <= {EPS} OR e1 * s + e2 * s * (s - 1) <= {EPS} THEN 0.0 ELSE (pi - theta_w) / sqrt(e1 * s + e2 * s * (s - 1)) END AS tajima_d
  FROM td0
)"""

_WIDTH = """, st AS (SELECT pool_idx, avg(tajima_d) AS mean_d, greatest(stddev_pop(tajima_d), 2.220446049250313e-16) AS sd_d FROM td WHERE tajima_d IS NOT NULL GROUP BY 1),
w0 AS (
  SELECT td.*, mean_d, sd_d, abs(tajima_d - mean_d) >= 1.0 AS strong, lag(pos_fin) OVER (PARTITION BY pool_idx, chr ORDER BY pos_ini) AS lf FROM td JOIN st USING (pool_idx) WHERE tajima_d IS NOT NULL
), w1 AS (SELECT *, sum(CASE WHEN strong AND pos_ini <= lf THEN 0 ELSE 1 END) OVER (PARTITION BY pool_idx, chr ORDER BY pos_ini) AS island FROM w0),
wd AS MATERIALIZED (SELECT *, sum(CASE WHEN strong THEN pos_fin - pos_ini ELSE 0 END) OVER (PARTITION BY pool_idx, chr, island ORDER BY pos_ini) AS width FROM w1)"""

_FW = f""", fw AS MATERIALIZED (
  SELECT w.chr, pos_ini, pos_fin, pool_a, pool_b, CASE WHEN count(fst) = count(*) THEN avg(fst) END AS fst FROM fst {_IN.format('fst')} GROUP BY 1, 2, 3, 4, 5
), fw2 AS (SELECT * FROM fw UNION ALL SELECT chr, pos_ini, pos_fin, pool_b, pool_a, fst FROM fw WHERE pool_a <> pool_b)"""


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


#: Pearson over five pools: the last label left out, three degrees of freedom.
_PEARSON = f""", lastlabel AS (SELECT *, max(ord) OVER (PARTITION BY chr, pos) AS top FROM f),
r00 AS (
  SELECT chr, pos, allele AS alleles, phenotype, freq, freq - avg(freq) OVER v AS dx, y.y - avg(y.y) OVER v AS dy
  FROM lastlabel JOIN y USING (pool_idx) WHERE ord < top WINDOW v AS (PARTITION BY chr, pos, allele, phenotype)
), r0 AS (
  SELECT chr, pos, alleles, phenotype, avg(freq) AS freq, CASE WHEN sum(dx * dx) > 1e-12 THEN round(sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)), 7) END AS r FROM r00 GROUP BY 1, 2, 3, 4
), r1 AS (SELECT *, abs(r) / sqrt(greatest(1 - r * r, {EPS}) / 3) / sqrt(3) AS u FROM r0),
r2 AS (SELECT *, CASE WHEN r * r >= 1 THEN {EPS} ELSE 2 * (0.5 - (u / (1 + u * u) + atan(u)) / pi()) END AS pvalue FROM r1)"""


def _allele(likelihood: bool) -> str:
    """Regression of each trait on each allele over five pools; t with four degrees of freedom."""
    t = "beta / (2 * sse / 5 / sxx)" if likelihood else "beta / sqrt(sse / 3 / sxx)"
    return f"""{filtered()}, s AS (
  SELECT chr, pos, allele AS alleles, phenotype, avg(freq) AS freq, regr_slope(y.y, freq) AS beta, regr_sxx(y.y, freq) AS sxx, regr_syy(y.y, freq) AS syy, regr_sxy(y.y, freq) AS sxy
  FROM f JOIN y USING (pool_idx) GROUP BY 1, 2, 3, 4
), s1 AS (SELECT *, syy - sxy * sxy / sxx AS sse FROM s WHERE sxx > 1e-12), s2 AS (SELECT *, abs({t}) AS t FROM s1)
SELECT chr, pos, alleles, phenotype, {_r('freq')} AS freq, {_r('beta', 2)} AS statistic,
       {_r('1 - 0.75 * t / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4)))')} AS pvalue FROM s2"""


def _biallelic(kind: str) -> str:
    """Regression on the allele of A and T with the lesser total; t with four degrees of freedom over five pools."""
    added = 1.0 if kind == "ridge" else 0.0
    t = "beta / (2 * sse / 5 / d)" if kind == "mle" else "beta / sqrt(sse / 3 / d)"
    two = filtered().replace("FROM c WHERE allele <> 'N'", "FROM c WHERE allele IN ('A', 'T')")
    return f"""{two}, t AS (SELECT *, round(sum(coalesce(freq, 0)) OVER (PARTITION BY chr, pos, allele), 9) AS total FROM f),
u AS (SELECT *, dense_rank() OVER (PARTITION BY chr, pos ORDER BY total DESC, ord) AS place FROM t),
s AS (
  SELECT chr, pos, allele AS alleles, phenotype, avg(freq) AS freq, regr_sxx(y.y, freq) AS sxx, regr_syy(y.y, freq) AS syy, regr_sxy(y.y, freq) AS sxy
  FROM u JOIN y USING (pool_idx) WHERE place = 2 GROUP BY 1, 2, 3, 4
), s0 AS (SELECT *, sxx + {added} AS d, sxy / (sxx + {added}) AS beta FROM s WHERE sxx > 1e-11 OR {added} > 0),
s1 AS (SELECT *, syy - 2 * beta * sxy + beta * beta * sxx AS sse FROM s0),
s2 AS (SELECT *, CASE WHEN abs(beta) <= {EPS} THEN 0 ELSE abs({t}) END AS t FROM s1)
SELECT chr, pos, alleles, phenotype, {_r('freq')} AS freq, {_r('beta', 2)} AS statistic,
       {_r('1 - 0.75 * t / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4)))')} AS pvalue FROM s2"""


def _joint(kind: str) -> str:
    """Regression on an intercept and all alleles but the major, by elimination on the normal equations; t with four degrees of freedom over five pools."""
    each, sum_ = "list_transform(range(1, len({0}) + 1), lambda {1}: {2})".format, "list_sum(list_transform(range(1, len({0}) + 1), lambda {1}: {2}))".format
    added = "CASE WHEN i = j AND i > 1 THEN 1.0 ELSE 0.0 END" if kind == "ridge" else "0.0"
    gram = each("x", "i", "list_concat(" + each("x", "j", sum_("x[i]", "q", "x[i][q] * x[j][q]") + f" + {added}") + ", " + each("x", "j", "CASE WHEN i = j THEN 1.0 ELSE 0.0 END") + ")")
    steps = "".join(
        f", m{k} AS MATERIALIZED (SELECT * EXCLUDE m, CASE WHEN len(m) < {k} THEN m ELSE " + each("m", "i", each(f"m[{k}]", "j", f"CASE WHEN i = {k} THEN m[i][j] / m[{k}][{k}] ELSE m[i][j] - m[i][{k}] * (m[{k}][j] / m[{k}][{k}]) END")) + f" END AS m FROM m{k - 1})"
        for k in range(1, 6)
    )
    near = ", ".join(f"coalesce(bool_or(near) FILTER (a = {a} AND b = {b}), false) AS n{a}{b}" for a in range(2, 5) for b in range(a + 1, 6))
    largest = "list_max(list_transform({0}, lambda r: list_sum(list_transform({1}, lambda v: abs(v)))))".format
    error = "2 * sse / 5" if kind == "mle" else "CASE WHEN len(x) < 5 THEN sse / (5 - len(x)) END"
    stays = "JOIN gone USING (chr, pos) WHERE NOT list_contains(gs, place)" if kind == "mle" else ""
    spread = "e * inv[j][j]" if kind == "mle" else "sqrt(e * inv[j][j])"
    return f"""{filtered()}, t AS (SELECT *, round(sum(coalesce(freq, 0)) OVER (PARTITION BY chr, pos, allele), 9) AS total FROM f),
u AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY chr, pos ORDER BY total DESC, ord) AS place FROM t),
pairs AS (
  SELECT v.chr, v.pos, v.place AS a, w.place AS b, sqrt(regr_sxx(v.freq, w.freq) * regr_syy(v.freq, w.freq)) AS s, regr_sxy(v.freq, w.freq) AS sxy
  FROM u v JOIN u w ON v.chr = w.chr AND v.pos = w.pos AND v.pool_idx = w.pool_idx AND v.place > 1 AND v.place < w.place GROUP BY 1, 2, 3, 4
), near AS (SELECT chr, pos, a, b, s > {EPS} AND floor(abs(sxy / s) * 1e7 + 0.5) / 1e7 >= 0.99 AS near FROM pairs),
nr AS (SELECT l.chr, l.pos, {near} FROM (SELECT DISTINCT chr, pos FROM u) l LEFT JOIN near USING (chr, pos) GROUP BY 1, 2),
ng AS (SELECT *, n24 OR (n34 AND NOT n23) AS g4 FROM nr),
gone AS (SELECT chr, pos, list_concat(CASE WHEN n23 THEN [3] ELSE [] END, CASE WHEN g4 THEN [4] ELSE [] END, CASE WHEN n25 OR (n35 AND NOT n23) OR (n45 AND NOT g4) THEN [5] ELSE [] END) AS gs FROM ng),
cols AS (SELECT chr, pos, place, allele, list(freq ORDER BY pool_idx) AS v FROM u WHERE place > 1 GROUP BY 1, 2, 3, 4),
d AS (SELECT chr, pos, list_concat([[1.0::DOUBLE, 1.0, 1.0, 1.0, 1.0]], list(v ORDER BY place)) AS x, list(allele ORDER BY place) AS names FROM cols {stays} GROUP BY 1, 2),
m0 AS MATERIALIZED (SELECT *, {gram} AS m FROM d){steps},
i0 AS (SELECT chr, pos, x, names, list_transform(m, lambda r: r[len(m) + 1:]) AS inv FROM m5),
i1 AS (SELECT i0.*, list_transform(m0.m, lambda r: r[:len(m0.m)]) AS g FROM i0 JOIN m0 USING (chr, pos)),
i2 AS (SELECT * FROM i1 WHERE {largest('g', 'r')} * {largest('inv', 'r')} <= 1e12),
yl AS (SELECT phenotype, list(y ORDER BY pool_idx) AS ys FROM y GROUP BY 1),
c0 AS (SELECT i2.*, phenotype, ys, {each('x', 'j', sum_('ys', 'q', 'x[j][q] * ys[q]'))} AS xy FROM i2, yl),
b0 AS (SELECT *, {each('x', 'j', sum_('xy', 'q', 'inv[j][q] * xy[q]'))} AS beta FROM c0),
s0 AS (SELECT *, {each('ys', 'q', 'ys[q] - ' + sum_('x', 'j', 'x[j][q] * beta[j]'))} AS rest FROM b0),
s1 AS (SELECT *, {sum_('rest', 'q', 'rest[q] * rest[q]')} AS sse FROM s0),
s2 AS (SELECT *, {error} AS e FROM s1),
s3 AS (SELECT chr, pos, x, names, phenotype, e, inv, beta, unnest(range(2, len(x) + 1)) AS j FROM s2),
s4 AS (SELECT chr, pos, names[j - 1] AS alleles, list_avg(x[j]) AS freq, phenotype, beta[j] AS beta, CASE WHEN abs(beta[j]) <= {EPS} THEN 0 WHEN e IS NULL THEN NULL ELSE abs(beta[j] / ({spread})) END AS t FROM s3)
SELECT chr, pos, alleles, phenotype, {_r('freq')} AS freq, {_r('beta', 2)} AS statistic,
       CASE WHEN t IS NULL THEN 1.0 WHEN t > 1e6 THEN 0.0 ELSE {_r('1 - 0.75 * t / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4)))')} END AS pvalue FROM s4"""


def _normal_tail(x: str, mean: str, sd: str) -> str:
    """Normal tail beyond x on its side of the mean, by the series of the distribution function around its middle."""
    z = f"least(abs({x} - {mean}) / {sd}, 9.0)"
    term = "exp((2 * k + 1) * ln(z) + (k + 1) * ln(2) + lgamma(k + 2) - lgamma(2 * k + 3))"
    total = f"list_sum(list_transform(range(0, 160), lambda k: {term.replace('ln(z)', f'ln(greatest({z}, 1e-300))')}))"
    return f"greatest(0.0, 0.5 - exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {total})"


#: Upper tail of chi-square for any whole number of degrees of freedom: one less the series of the lower one.
_CHI2 = "1 - CASE WHEN statistic <= 0 THEN 0 ELSE list_sum(list_transform(range(0, 400), lambda k: exp((df / 2 + k) * ln(statistic / 2) - statistic / 2 - lgamma(df / 2 + k + 1)))) END"

#: Long rows without N, coverage below 3 missing.
_LONG = BASE + """, n0 AS (SELECT *, sum(n) OVER (PARTITION BY chr, pos, pool_idx) AS cov FROM c WHERE allele <> 'N'),
m AS (SELECT chr, pos, allele, pool_idx, CASE WHEN cov >= 3 THEN n / cov END AS freq, CASE WHEN cov >= 3 THEN CAST(cov AS DOUBLE) END AS coverage FROM n0),
cell AS (SELECT chr, pos, pool_idx, max(CASE WHEN coverage IS NULL THEN 1 ELSE 0 END) AS missing FROM m GROUP BY 1, 2, 3)"""


def _drop_pools(share: float) -> str:
    return f""", pm AS (SELECT pool_idx, sum(missing) AS missing FROM cell GROUP BY 1),
pk AS (SELECT pool_idx, row_number() OVER (ORDER BY missing, pool_idx) AS place, count(*) OVER () AS n, sum(CASE WHEN missing > 0 THEN 1 ELSE 0 END) OVER () AS holes FROM pm),
mp AS (SELECT m.* FROM m JOIN pk USING (pool_idx) WHERE place <= n - ceil(holes * {share}))"""


def _drop_loci(share: float, source: str = "m") -> str:
    return f""", lm AS (
  SELECT chr, pos, sum(missing) AS missing FROM (SELECT chr, pos, pool_idx, max(CASE WHEN coverage IS NULL THEN 1 ELSE 0 END) AS missing FROM {source} GROUP BY 1, 2, 3) GROUP BY 1, 2
), lk AS (SELECT chr, pos, row_number() OVER (ORDER BY missing, chr, pos) AS place, count(*) OVER () AS n, sum(CASE WHEN missing > 0 THEN 1 ELSE 0 END) OVER () AS holes FROM lm),
ml AS (SELECT s.* FROM {source} s JOIN lk USING (chr, pos) WHERE place <= n - ceil(holes * {share}))"""


def _mean(source: str) -> str:
    return f""", am AS (SELECT chr, pos, allele, avg(freq) AS mean FROM {source} GROUP BY 1, 2, 3),
as_ AS (SELECT *, mean / nullif(sum(mean) OVER (PARTITION BY chr, pos), 0) AS scaled FROM am),
mi AS (SELECT s.chr, s.pos, s.allele, s.pool_idx, coalesce(s.freq, scaled) AS freq, s.coverage IS NULL AND scaled IS NOT NULL AS was_missing FROM {source} s JOIN as_ USING (chr, pos, allele))"""


def oracles() -> dict[str, str]:
    flat = lambda names: ", ".join(f"coalesce(max(CASE WHEN allele = '{x.upper()}' THEN n END), 0) AS n_{x}" if x in names else f"0 AS n_{x}" for x in "atcgdn")
    long = f"SELECT chr, pos, allele, pool_idx, {_r('freq')} AS freq FROM f"
    counts = lambda names: f"{BASE} SELECT chr, pos, pool_idx, {flat(names)} FROM c GROUP BY 1, 2, 3"
    all_ = filtered()
    width = all_ + _PI + WINDOWS + _TAJIMA + _WIDTH
    lf = "lgamma({} + 1) / ln(10)"
    return {
        "sync_counts": counts("atcgdn"),
        "sync_text": counts("atcgdn"),
        "vcf_text": counts("atcgd"),
        "pileup_text": counts("atcgd"),
        "pileup_lowercase": f"""{BASE} SELECT chr, pos, pool_idx, {flat("atcgd")}, true AS asked FROM c GROUP BY 1, 2, 3
          UNION ALL SELECT chr, pos, pool_idx, {flat("atcgd").replace("allele = 'A'", "allele = ''").replace("0 AS n_n", "max(CASE WHEN allele = 'A' THEN n END) AS n_n")}, false AS asked FROM c GROUP BY 1, 2, 3""",
        "allele_freqs": f"{BASE} SELECT chr, pos, allele, pool_idx, {_r('n / nullif(sum(n) OVER (PARTITION BY chr, pos, pool_idx), 0)')} AS freq FROM c",
        "filtered_freqs": filtered(maf=0.05) + long,
        "freqs_filtered": filtered(maf=0.05) + f" SELECT chr, pos, allele, pool_idx, {_r('n / nullif(cov, 0)')} AS freq FROM f0",
        "enough_alleles": f"""{BASE}, v AS (SELECT c.*, size, n / nullif(sum(n) OVER (PARTITION BY chr, pos, pool_idx), 0) AS freq FROM c JOIN p USING (pool_idx) WHERE allele <> 'N'),
          q AS (SELECT chr, pos, allele, sum(coalesce(freq, 0) * size) / sum(size) AS qa FROM v GROUP BY 1, 2, 3)
          SELECT chr, pos FROM q WHERE qa BETWEEN 0.2 AND 0.8 GROUP BY 1, 2 HAVING count(*) >= 2""",
        "missingness_filter": filtered(depth=0, missing=0.2) + long,
        "major_allele_dropped": f"""{all_}, t AS (SELECT *, round(sum(coalesce(freq, 0)) OVER (PARTITION BY chr, pos, allele), 9) AS total FROM f),
          u AS (SELECT *, dense_rank() OVER (PARTITION BY chr, pos ORDER BY total DESC, ord) AS place FROM t)
          SELECT chr, pos, allele, pool_idx, {_r('freq')} AS freq FROM u WHERE place > 1""",
        "sync2csv_wide": all_ + " SELECT chr, pos, allele, " + ", ".join(f"round(max(CASE WHEN pool_idx = {i} THEN freq END), 6) AS pool_{i}" for i in range(5)) + " FROM f GROUP BY 1, 2, 3",
        "coverage_breadth_filter": f"""{BASE}, v AS (SELECT chr, pos, pool_idx, sum(n) AS cov FROM c GROUP BY 1, 2, 3)
          SELECT chr, pos, count(*) FILTER (cov >= 5) AS n_pass FROM v GROUP BY 1, 2 HAVING count(*) FILTER (cov >= 5) >= ceil(5 * 0.8)""",
        "freqs_to_counts": f"""{all_}, v AS (SELECT *, min(CASE WHEN freq > 0 THEN freq END) OVER (PARTITION BY chr, pos, pool_idx) AS least FROM f)
          SELECT chr, pos, allele, pool_idx, CAST(round(freq / least) AS BIGINT) AS n FROM v""",
        "chisq_stat": f"""{all_}, v AS (
            SELECT *, sum(freq) OVER (PARTITION BY chr, pos, pool_idx) * sum(freq) OVER (PARTITION BY chr, pos, allele) / sum(freq) OVER (PARTITION BY chr, pos) AS e FROM f)
          SELECT chr, pos, string_agg(allele, '' ORDER BY ord) FILTER (pool_idx = 0) AS alleles, {_r('sum((freq - e) * (freq - e) / e)')} AS statistic, count(*) - 1 AS df FROM v GROUP BY 1, 2""",
        "chisq_test": f"""{all_}, v AS (
            SELECT *, sum(freq) OVER (PARTITION BY chr, pos, pool_idx) * sum(freq) OVER (PARTITION BY chr, pos, allele) / sum(freq) OVER (PARTITION BY chr, pos) AS e FROM f),
          x2 AS (SELECT chr, pos, string_agg(allele, '' ORDER BY ord) FILTER (pool_idx = 0) AS alleles, sum((freq - e) * (freq - e) / e) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df FROM v GROUP BY 1, 2)
          SELECT chr, pos, alleles, {_r('statistic')} AS statistic, {_r(_CHI2)} AS pvalue FROM x2""",
        "fisher_observed": f"""{all_}, v AS (SELECT *, sum(n) OVER (PARTITION BY chr, pos) AS total FROM f),
          m AS (SELECT *, CASE WHEN total > 34 THEN floor(n * (34.0 / total)) ELSE n END AS x FROM v),
          cells AS (SELECT chr, pos, string_agg(allele, '' ORDER BY ord) FILTER (pool_idx = 0) AS alleles, sum({lf.format('x')}) AS s, {lf.format('sum(x)')} AS t FROM m GROUP BY 1, 2),
          mr AS (SELECT chr, pos, sum({lf.format('x')}) AS s FROM (SELECT chr, pos, pool_idx, sum(x) AS x FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
          mc AS (SELECT chr, pos, sum({lf.format('x')}) AS s FROM (SELECT chr, pos, allele, sum(x) AS x FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2)
          SELECT chr, pos, alleles, round(mr.s + mc.s - cells.s - cells.t, 6) AS statistic FROM cells JOIN mr USING (chr, pos) JOIN mc USING (chr, pos)""",
        "pearson_corr": f"{all_}{_PEARSON} SELECT chr, pos, alleles, {_r('freq')} AS freq, phenotype, r AS statistic, {_r('pvalue')} AS pvalue FROM r2",
        "ols_allele": _allele(False),
        "mle_allele": _allele(True),
        "ols_iter": _joint("ols"),
        "mle_iter": _joint("mle"),
        "ridge_iter": _joint("ridge"),
        "ols_iter_biallelic": _biallelic("ols"),
        "mle_iter_biallelic": _biallelic("mle"),
        "ridge_iter_biallelic": _biallelic("ridge"),
        "kinship": f"""{all_}, n AS (SELECT count(DISTINCT (chr, pos, allele)) AS p FROM f)
          SELECT u.pool_idx AS pool_a, v.pool_idx AS pool_b, {_r('sum(u.freq * v.freq) / max(p)')} AS kinship FROM f u JOIN f v USING (chr, pos, allele), n GROUP BY 1, 2""",
        "pi_per_locus": f"{all_}{_PI} SELECT chr, pos, pool_idx, {_r('pi')} AS pi FROM x",
        "fst_per_locus": f"{all_}{_FST} SELECT chr, pos, pool_a, pool_b, {_r('fst')} AS fst FROM fst",
        "fst_genome": f"""{all_}{_FST}, t AS (SELECT pool_a, pool_b, avg(fst) AS fst FROM fst GROUP BY 1, 2)
          SELECT pool_a, pool_b, {_r('fst')} AS fst FROM t UNION ALL SELECT pool_b, pool_a, {_r('fst')} FROM t WHERE pool_a <> pool_b""",
        "windows": f"{all_}{WINDOWS} SELECT * FROM w",
        "pi_windows": f"{all_}{_PI}{WINDOWS} SELECT w.chr, pos_ini, pos_fin, pool_idx, {_r('avg(pi)')} AS pi FROM x {_IN.format('x')} GROUP BY 1, 2, 3, 4",
        "pi_report": f"""{all_}{_PI}{WINDOWS}, v AS (SELECT w.chr, pos_ini, pos_fin, pool_idx, avg(pi) AS pi FROM x {_IN.format('x')} GROUP BY 1, 2, 3, 4)
          SELECT concat('pool_', pool_idx) AS pool, {_r('avg(pi)')} AS mean_across_windows, count(*) AS n_windows FROM v GROUP BY 1""",
        "fst_windows": f"{all_}{_FST}{WINDOWS} SELECT w.chr, pos_ini, pos_fin, pool_a, pool_b, {_r('avg(fst)')} AS fst FROM fst {_IN.format('fst')} GROUP BY 1, 2, 3, 4, 5",
        "watterson_windows": f"{all_}{_PI}{WINDOWS}{_TAJIMA} SELECT chr, pos_ini, pos_fin, pool_idx, {_r('theta_w')} AS theta_w FROM td",
        "tajima_windows": f"{all_}{_PI}{WINDOWS}{_TAJIMA} SELECT chr, pos_ini, pos_fin, pool_idx, {_r('pi')} AS pi, {_r('theta_w')} AS theta_w, {_r('tajima_d')} AS tajima_d FROM td",
        "tajima_widths": f"{width} SELECT chr, pos_ini, pos_fin, pool_idx, {_r('mean_d')} AS mean_d, {_r('sd_d')} AS sd_d, CAST(width AS BIGINT) AS width FROM wd",
        "gudmc_deltas": f"""{width}{_FST}{_FW},
          mo AS (SELECT pool_a, pool_b, avg(fst) AS mean_fst, greatest(stddev_pop(fst), {EPS}) AS sd_fst FROM fw2 WHERE fst IS NOT NULL GROUP BY 1, 2)
          SELECT fw2.pool_a, fw2.pool_b, fw2.chr, fw2.pos_ini, fw2.pos_fin, {_r('mean_d')} AS mean_tajima_d_pop_b, {_r('mean_fst')} AS mean_fst, {_r('sd_d')} AS sd_tajima_d_pop_b, {_r('sd_fst')} AS sd_fst,
                 {_r('tajima_d')} AS tajima_d_pop_b, {_r('CAST(width AS DOUBLE)')} AS tajima_width_pop_b, {_r('width - 0.73 / 100 * 1e6')} AS tajima_width_deviation_from_r_pop_b, {_r('fst - mean_fst')} AS fst_delta
          FROM fw2 JOIN wd ON wd.chr = fw2.chr AND wd.pos_ini = fw2.pos_ini AND wd.pos_fin = fw2.pos_fin AND wd.pool_idx = fw2.pool_b JOIN mo ON mo.pool_a = fw2.pool_a AND mo.pool_b = fw2.pool_b""",
        "gudmc": f"""{width}{_FST}{_FW},
          mo AS (SELECT pool_a, pool_b, avg(fst) AS mean_fst, greatest(stddev_pop(fst), {EPS}) AS sd_fst FROM fw2 WHERE fst IS NOT NULL GROUP BY 1, 2),
          sp AS (SELECT pool_idx, avg(width) AS mean_w, greatest(stddev_pop(width), {EPS}) AS sd_w FROM wd GROUP BY 1)
          SELECT fw2.pool_a, fw2.pool_b, fw2.chr, fw2.pos_ini, fw2.pos_fin, {_r('mean_d')} AS mean_tajima_d_pop_b, {_r('mean_fst')} AS mean_fst, {_r('sd_d')} AS sd_tajima_d_pop_b, {_r('sd_fst')} AS sd_fst,
                 {_r('tajima_d')} AS tajima_d_pop_b, {_r('CAST(width AS DOUBLE)')} AS tajima_width_pop_b, {_r('width - 0.73 / 100 * 1e6')} AS tajima_width_deviation_from_r_pop_b,
                 {_r(_normal_tail('width', 'mean_w', 'sd_w'))} AS tajima_width_one_tail_pval_pop_b, {_r('fst - mean_fst')} AS fst_delta, {_r(_normal_tail('fst', 'mean_fst', 'sd_fst'))} AS fst_delta_one_tail_pval
          FROM fw2 JOIN wd ON wd.chr = fw2.chr AND wd.pos_ini = fw2.pos_ini AND wd.pos_fin = fw2.pos_fin AND wd.pool_idx = fw2.pool_b JOIN mo ON mo.pool_a = fw2.pool_a AND mo.pool_b = fw2.pool_b
               JOIN sp ON sp.pool_idx = fw2.pool_b WHERE fst IS NOT NULL""",
        "missing_by_depth": f"{_LONG} SELECT chr, pos, allele, pool_idx, {_r('freq')} AS freq, {_r('coverage')} AS coverage FROM m",
        "missing_rate": f"{_LONG} SELECT round(100 * avg(missing), 2) AS missing_rate FROM cell",
        "drop_missing_pools": f"{_LONG}{_drop_pools(0.25)} SELECT pool_idx, count(freq) AS n FROM mp GROUP BY 1",
        "drop_missing_loci": f"{_LONG}{_drop_loci(0.3)} SELECT DISTINCT chr, pos FROM ml",
        "mean_impute": f"{_LONG}{_mean('m')} SELECT chr, pos, allele, pool_idx, {_r('freq')} AS freq, was_missing FROM mi",
        "impute_pipeline": f"""{_LONG}{_drop_pools(0.1)}{_drop_loci(0.1, 'mp')}{_mean('ml')}
          SELECT chr, pos, allele, pool_idx, {_r('freq')} AS freq FROM mi WHERE (chr, pos) NOT IN (SELECT (chr, pos) FROM mi WHERE freq IS NULL)""",
        "expand_and_contract": f"""{all_}, s AS (
            SELECT chr, pos, allele AS alleles, regr_slope(y.y, freq) AS slope, regr_sxx(y.y, freq) AS sxx FROM f JOIN y USING (pool_idx) WHERE phenotype = 'Pheno_0' GROUP BY 1, 2, 3),
          b AS (SELECT chr, pos, alleles, round(slope, 2) / 1000 AS beta FROM s WHERE sxx > 1e-12),
          z0 AS (SELECT *, 0.5 * beta * beta + 0.5 * abs(beta) AS size FROM b),
          z1 AS (SELECT *, size / max(size) OVER () < 0.1 AS small, beta >= 0 AS up, least(abs(beta), size) AS cut FROM z0),
          t0 AS (SELECT coalesce(sum(cut) FILTER (small AND up), 0) AS less, coalesce(sum(cut) FILTER (small AND NOT up), 0) AS more,
                        coalesce(sum(size) FILTER (NOT small AND up), 0) AS ups, coalesce(sum(size) FILTER (NOT small AND NOT up), 0) AS downs FROM z1),
          t1 AS (SELECT CASE WHEN ups > 0 THEN (CASE WHEN more > 0 AND downs = 0 THEN less - more ELSE less END) / ups ELSE 0 END AS gu,
                        CASE WHEN downs > 0 THEN (CASE WHEN less > 0 AND ups = 0 THEN more - less ELSE more END) / downs ELSE 0 END AS gd FROM t0)
          SELECT chr, pos, alleles, {_r('beta')} AS beta,
                 {_r('CASE WHEN small AND up THEN beta - cut WHEN small THEN beta + cut WHEN up THEN beta + gu * size ELSE beta - gd * size END')} AS penalised FROM z1, t1""",
        "sig_snps_bonferroni": f"""{all_}{_PEARSON}, t AS (SELECT count(*) / count(DISTINCT phenotype) AS n FROM r2)
          SELECT chr, pos, alleles, phenotype, r AS statistic, {_r('pvalue')} AS pvalue FROM r2, t WHERE pvalue < 0.05 / n""",
        "sig_snps_planted": f"""{all_}, fo AS (SELECT *, min(ord) OVER (PARTITION BY chr, pos) AS low FROM f),
          pk AS (SELECT chr, pos FROM fo WHERE ord = low GROUP BY 1, 2 HAVING max(freq) - min(freq) > 0.1 ORDER BY chr, pos LIMIT 1),
          yp AS (SELECT pool_idx, 'Pheno_0' AS phenotype, 100 * freq AS y FROM fo JOIN pk USING (chr, pos) WHERE ord = low){_PEARSON.replace('y.y', 'yp.y').replace('JOIN y USING', 'JOIN yp USING')},
          t AS (SELECT count(*) / count(DISTINCT phenotype) AS n FROM r2)
          SELECT chr, pos, alleles, phenotype, r AS statistic, {_r('pvalue')} AS pvalue FROM r2, t WHERE pvalue < 0.05 / n""",
        "manhattan_data": f"""{all_}{_PEARSON}, v AS (SELECT * FROM r2 WHERE pvalue IS NOT NULL), len AS (SELECT chr, max(pos) AS length FROM v GROUP BY 1),
          o AS (SELECT chr, coalesce(sum(length) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM len)
          SELECT chr, pos, alleles, phenotype, CAST(pos + before AS BIGINT) AS x, {_r('-log10(pvalue)')} AS neg_log10_p FROM v JOIN o USING (chr)""",
        "ks_statistic": f"""{all_}{_PEARSON}, v AS (SELECT phenotype, pvalue, row_number() OVER (PARTITION BY phenotype ORDER BY pvalue) AS i, count(*) OVER (PARTITION BY phenotype) AS n FROM r2 WHERE pvalue > 0)
          SELECT phenotype, {_r('max(greatest(abs(pvalue - (i - 1) / n), abs(pvalue - i / n)))')} AS ks FROM v GROUP BY 1""",
        "qq_data": f"""{all_}{_PEARSON}, v AS (SELECT phenotype, pvalue, row_number() OVER (PARTITION BY phenotype ORDER BY pvalue) AS i, count(*) OVER (PARTITION BY phenotype) AS n FROM r2 WHERE pvalue > 0)
          SELECT phenotype, {_r('-log10(pvalue)')} AS observed, {_r('-log10((i - 0.5) / n)')} AS expected FROM v""",
    }
