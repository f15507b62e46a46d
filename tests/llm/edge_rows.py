"""Rows that every operator has to bear."""

LONG = " ".join(f"word{i * 7919 % 2003}" for i in range(3000))
SHARED = " ".join(f"passage{i}" for i in range(80))
#: doc_id, text: empty, null, short, repeated rows, a null id, one letter over and over, very long, other scripts.
EDGE = [
    (1, ""), (2, None), (3, "one two"), (3, "one two"), (4, "a" * 5000), (5, LONG), (6, LONG), (None, LONG), (None, None),
    (7, "Grüße aus Köln, 東京 und 🙂 <|endoftext|> it's 12½ o'clock  \n\n ok"), (8, "123 456 ..."), (9, SHARED), (10, "before " + SHARED + " after"),
    (11, "x" * 399), (12, "yz " * 400), (13, " \t\n "), (14, LONG[:9000] + " and one more end"), (15, SHARED.upper()),
]
#: Columns of any table may have the names that the operators use.
CLASH = ("h", "h1", "h2", "id", "key", "start", "n", "spans", "rest", "score", "bucket", "component", "text_1", "shard", "label", "lettered")
