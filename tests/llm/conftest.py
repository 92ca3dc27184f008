import pyarrow as pa
import pytest

#: Columns that clash with names the operators use inside.
CLASHING = {
    "row": "string", "score": "string", "_id": "string", "_kept": "string", "held_out": "string",
    "print": "string", "digest": "string", "length": "string",
}


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text[, lang]) rows, with extra columns."""

    def make(rows, extra=True):
        rows = [(*r, None)[:3] if len(r) < 3 else r for r in rows]
        data = {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "text": pa.array([r[1] for r in rows], pa.string()),
            "lang": pa.array([r[2] for r in rows], pa.string()),
            "source": pa.array(["s"] * len(rows), pa.string()),
            "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()),
        }
        if extra:
            data.update({n: pa.array(["x"] * len(rows), pa.string()) for n in CLASHING})
        return spark.createDataFrame(pa.table(data))

    return make
