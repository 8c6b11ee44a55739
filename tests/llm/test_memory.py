"""What worker processes hold between tasks."""

from __future__ import annotations

import pickle

import psutil
from pyspark import cloudpickle

from quadspark.llm import common, token_store


def test_a_task_gives_its_memory_back():
    common.word_hashes([b"a b " * 100_000])
    many = [bytes(700) for _ in range(200_000)]
    last = many[-1]
    del many
    held = psutil.Process().memory_info().rss
    assert list(common.released(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert len(common._powers[0]) == 1 and len(last) == 700
    assert psutil.Process().memory_info().rss < held - 80e6


def test_counting_drops_the_encoders():
    """The counting task neither carries the driver's tokenizer nor leaves the worker's."""
    kept = []

    class Tokens:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            kept.append(run)
            raise StopIteration

    token_store.encoder(token_store.vocabulary_path())
    try:
        token_store.token_counts(Tokens(), "<u2")
    except StopIteration:
        pass
    packed = cloudpickle.dumps(kept[0])
    assert len(packed) < 20_000
    list(pickle.loads(packed)(iter([])))
    assert not token_store._encoders
