"""Filters, tests, scans, diversity, imputation and prediction over allele counts."""
