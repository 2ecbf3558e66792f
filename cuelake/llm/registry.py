"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from . import bpe_codec, decontamination, exact_dedup, language_id, license_scan, near_dedup, quality, sharding, token_counts, url_filters

MODULES = (near_dedup, license_scan, exact_dedup, token_counts, quality, decontamination, sharding, url_filters, bpe_codec, language_id)


def queries():
    named = {name: getattr(module, name) for module in MODULES for name in dir(module) if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(named.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in getattr(module, "SQL", {}).items()}
