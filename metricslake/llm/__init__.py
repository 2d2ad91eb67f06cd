"""Training-data operators: joins on near-duplicate text, vector search, personal data,
source mixing, licence scans, language ID, WARC archives, repeat removal and tokenizing.

Each module holds one operator with its general interface; ``registry.py`` binds them to
the given tables as queries ``opN_<name>``.
"""
