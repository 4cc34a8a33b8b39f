"""Documents through five operators in turn: language ID, quality, exact dedup, near dedup, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs. run() applies them to the documents of a folder.
"""

from verbarium.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
