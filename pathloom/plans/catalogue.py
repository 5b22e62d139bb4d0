"""All core queries by name, with their SQL where SQL can express them."""

from pathloom.plans import chain_ops, data_ops, graph_ops, label_ops, model_ops, relation_ops, selection_ops, series_ops, stream_ops

_MODULES = [data_ops, stream_ops, graph_ops, relation_ops, series_ops, label_ops, model_ops, selection_ops, chain_ops]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = "stat_view_full"
