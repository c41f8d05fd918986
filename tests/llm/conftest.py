import pytest

#: Extra columns whose names operators use for their own.
CLASH = {"kept": "x", "host": 1, "node": 2, "band": 3.0, "place": "p", "hits": 4, "id": 5, "n": 6}


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) rows, with columns of clashing names."""

    def make(rows, extra=True):
        clash = CLASH if extra else {}
        kinds = "doc_id long, text string, lang string, source string, n_chars long" + "".join(
            f", {k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in clash.items()
        )
        return spark.createDataFrame([(i, t, "en", None, len(t) if t is not None else None, *clash.values()) for i, t in rows], kinds)

    return make
