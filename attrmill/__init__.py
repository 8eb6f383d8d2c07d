"""attrmill: attribute-name curation analytics on Spark DataFrames.

Sparse samples (sample -> attribute -> value) go in; attribute statistics,
co-occurrence weights, lexically similar attribute pairs with a diagnosis of
why they differ, co-occurrence / value / sample features per pair, curation
queues and recommendations come out. Every operator takes and returns
DataFrames; nothing sample-sized is collected to the driver.
"""

from attrmill.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
