"""What the operators leave below the checkpoint folder."""
import os

import __spark_entry__ as entry
from valuemarts.llm import queries
from valuemarts.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def folders(spark):
    path = f"{checkpoint_dir(spark).removeprefix('file:')}/valuemarts"
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def test_nothing_is_left_after_a_release(spark):
    queries.release(spark)
    before = folders(spark)
    for name in ("op3_line_dedup", "op6_ann", "op7_near_dup", "op8_lm_score", "op9_token_file", "op11_phrases", "op12_suffix_dedup", "op13_ranked_search", "pipeline"):
        assert entry.queries()[name](spark, SF).count()
    assert folders(spark) - before
    assert queries.release(spark) >= 9 and folders(spark) - before == set()
    assert queries.release(spark) == 0
