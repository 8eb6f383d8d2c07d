import weakref

import pyarrow as pa

from attrmill.llm import common


def test_a_task_lets_its_memos_go():
    """A worker process is used again: neither the words of a task nor its scorer stay in it."""
    kept = []

    class Scorer:
        def __init__(self):
            self.memo = common.Memo(self.score)

        def score(self, word):
            return len(word)

    def stage(batches):
        scorer = Scorer()
        kept.append(weakref.ref(scorer))
        for b in batches:
            for t in b.column(0).to_pylist():
                scorer.memo[t], common.word_hash[t.encode()]
            yield b

    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"])], ["text"])
    stages = common._released(stage, [batch])
    assert [b.num_rows for b in stages] == [3]
    assert kept[0]() is None and not common.word_hash
