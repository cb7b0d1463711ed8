"""All registered queries.  Importing this module fills ``registry.QUERIES`` / ``ORACLE``."""

from tagstream.plans import q_files, q_functions, q_labels, q_metrics, q_quality, q_relational, q_streams, q_text, q_tree, q_windows  # noqa: F401
