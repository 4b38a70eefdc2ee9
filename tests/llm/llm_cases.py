"""Cases that the tests of this folder share."""

import pytest

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts (ids from 0) or (id, text) pairs."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    return make


#: Texts that every operator must take: null, empty, white space, odd characters, control
#: characters, very long, repeated.
ODD = [None, "", " \n\t ", "a", "a b c", "日本語 テキスト ☃ é", "x\x00y \x85 z q", "word " * 30000, "same text here", "same text here", "ÀÉ İ ß ퟿ \U0001f600"]
