"""Operators for preparing training data: license scans, quality rules, mixing, sharding, packing, joins, dedup, media,
page extraction and token files. Nothing else in the library imports this subpackage."""
