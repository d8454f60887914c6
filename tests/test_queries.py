import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows, names):
    def one(v):
        if v is None or v != v:
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, float) else v

    return sorted(repr(tuple(one(r[names.index(c)]) for c in sorted(names))) for r in rows)


@pytest.mark.parametrize("name", ["sync_counts", "pileup_text", "pileup_lowercase", "chisq_test", "gudmc", "impute_pipeline", "ols_iter", "mle_iter", "ridge_iter", "ols_iter_biallelic", "mle_iter_biallelic", "ridge_iter_biallelic", "filtered_freqs", "freqs_filtered", "enough_alleles", "ks_statistic", "major_allele_dropped", "chisq_stat", "fisher_observed", "pearson_corr", "ols_allele", "fst_windows", "tajima_windows", "mean_impute", "drop_missing_loci", "qq_data"])
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frame = entry.queries()[name](spark, sf_dir)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert norm([tuple(r) for r in frame.collect()], frame.columns) == norm(found.fetchall(), names)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
