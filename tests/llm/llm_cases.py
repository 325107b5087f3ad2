"""Rows that every operator must take."""

#: Null, empty, white space, short, repeated rows, a null id, and a long text.
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three"), (5, "one two three"), (None, "one two three"),
    (7, "a  b   c\n\n\nd <|endoftext|> é 日本"), (8, "wörd token = 'abcdefgh12' " * 3000), (9, "x" * 50_000),
]
