"""Schema of the odd table."""

#: Columns whose names are used inside the operators.
CLASHES = ("key", "sig", "n", "part", "cell", "salt", "rank", "cuts", "score", "column_0", "other_id", "same")
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)


def extra(rows):
    return [(i, t, *(["x"] * len(CLASHES))) for i, t in rows]
