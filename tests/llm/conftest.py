import pyarrow as pa
import pytest


@pytest.fixture
def table(spark):
    """A DataFrame from columns; `types` for those that Arrow can't tell."""

    def make(types=None, **columns):
        types = types or {}
        arrays = {name: pa.array(values, types.get(name)) for name, values in columns.items()}
        return spark.createDataFrame(pa.table(arrays))

    return make


@pytest.fixture
def documents(table):
    """Documents with ids and texts, and columns whose names clash with the operators' own."""

    def make(rows):
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]
        n = len(rows)
        return table({"doc_id": pa.int64(), "text": pa.string(), "key": pa.int64(), "row": pa.string(), "id": pa.int64(), "n": pa.int64(),
                      "spans": pa.int64()}, doc_id=ids, text=texts, key=[1] * n, row=["r"] * n, id=[None] * n, n=[2] * n, spans=[3] * n)

    return make
