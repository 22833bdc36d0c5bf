import hashlib
from collections import Counter

import numpy as np
import pytest

from cohortry.functions.digest import numbered
from cohortry.operators import bootstrap


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("prefixes", [["5|1|a|0|", "5|2|a|0|"], [""], ["5|7|éé|1|"], ["x" * 51], ["x" * 90, "y" * 90]])
def test_numbers_of_many_texts_are_md5(prefixes):
    got = np.concatenate([p.of([t.encode() for t in prefixes]) for p in numbered(7, 1203)], axis=1)
    assert got.tolist() == [[number(f"{t}{k}") for k in range(7, 1203)] for t in prefixes]


def test_draws_of_a_stratum_of_many_chunks(spark):
    """Draws from two ranges of slots meet in the chunk they drew; a few packed rows a chunk and block stand for all of them."""
    n, replicates = bootstrap.SOURCE + 5000, 3
    subjects = spark.range(n).selectExpr("cast(id as int) patient_id", "'a' dataset", "1 label")
    ranked = sorted(range(n), key=lambda k: (number(f"9|{k}"), k))
    want = {(b, ranked[s]): w for b in range(replicates) for s, w in Counter(number(f"9|{b}|a|1|{k}") % n for k in range(n)).items()}
    got = bootstrap.draw_weights(subjects, replicates, 9).toPandas()
    assert dict(zip(zip(got["replicate"], got["patient_id"], strict=True), got["weight"], strict=True)) == want
    assert bootstrap.draw_blocks(subjects, replicates, 9).hits.count() <= 2 * (n // bootstrap.CHUNK + 1)
