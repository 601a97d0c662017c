"""Seeds of items that leaked to many documents."""
import numpy as np

from quarrystat.llm import decontam


def found(index, docs):
    df = np.zeros(len(index.grams), np.int64)
    for t in docs:
        df[np.unique(index.seeds(index.numbers(t))[0])] += 1
    index.keep_rare(df, len(docs))
    return [bool(list(index.hits(t))) for t in docs]


def test_half_and_edited_copies_of_a_leaked_item():
    w = [f"word{i}" for i in range(40)]
    item = " ".join(w)
    edited = " ".join("x" if i % 7 == 6 else x for i, x in enumerate(w))
    last, first, middle = " ".join(w[20:]), " ".join(w[:20]), " ".join(w[10:30])
    for docs in ([item, last], [item, first], [item] * 30 + [last], [item] * 30 + [last] * 9 + [first, edited],
                 [last] * 50 + [first] * 30 + [middle] * 20 + [edited] * 40 + [item]):
        docs = [f"before {t} after" for t in docs]
        clean = ["nothing of that kind is here"] * 100
        assert found(decontam.Index([(1, item)]), docs + clean) == [True] * len(docs) + [False] * 100
