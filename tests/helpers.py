"""Comparable forms of frames."""


def content(df):
    """Image and label of every row, in a comparable form."""
    return sorted(
        (tuple(r.image), tuple(float(v) for v in r.label)) for r in df.select("image", "label").collect()
    )
