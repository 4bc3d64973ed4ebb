"""Documents for the tests of the operators."""


def documents(session, *rows, extra=True):
    """Rows ``(doc_id, text)`` as documents, with columns whose names clash."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    docs = session.createDataFrame(full, ddl)
    if extra:
        names = ("kept", "n", "fp", "sha", "k1", "bucket", "score", "rank", "__sha", "text_sha256",
                 "key", "edges", "hit", "own", "named", "times", "keep", "once", "n_words", "body")
        docs = docs.withColumns({name: docs["source"] for name in names})
    return docs
