"""Documents with odd values, for all operators."""

from __future__ import annotations

#: Nulls, empty and blank texts, repeated rows and ids, a long text, and columns with clashing names.
ODD = [
    (7, None, None, None),
    (3, "", "en", "s1"),
    (4, " \t\n ", None, "s1"),
    (5, "the word and that other word of it\n" * 2000, "en", "s1"),
    (5, "the word and that other word of it\n" * 2000, "en", "s1"),
    (6, "12 + 34 = !!", "xx", None),
    (None, "no id is here but the text of it is read", "en", "s2"),
    (8, "Nicht der und die das ist ein Satz mit Wörtern", "de", "s2"),
]

#: Names that operators use for columns of their own.
INTERNAL = (
    "row key id of keep gone m votes quality_ label bands bits set_id text_id number common part at guard tie "
    "place shard slot task lane n hash share _key _id _gone _keep _text _m _votes"
).split()
