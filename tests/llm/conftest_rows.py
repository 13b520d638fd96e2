"""Rows that every operator must take."""


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a long text, a null id."""
    return [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "src1"),
        (2, "Alpha  beta gamma delta\nepsilon zeta ", "en", "src1"),
        (3, None, None, None),
        (4, "", "en", "src2"),
        (5, " \t\n", "fr", "src2"),
        (6, 'Été à la plage, 漢字 and 🙂 token = "abcdef123456"', "fr", "src3"),
        (6, 'Été à la plage, 漢字 and 🙂 token = "abcdef123456"', "fr", "src3"),
        (None, "a row without an id", "en", "src3"),
        (7, "word " * 5000 + "end", "en", "src1"),
        (8, "12345 --- 67890", "en", "src9"),
        (9, "Alpha beta gamma delta epsilon zeta", "en", None),
    ]
