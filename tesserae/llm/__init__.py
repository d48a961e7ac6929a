"""Training-data operators. Nothing outside this subpackage imports it.

Operators read doc_id and text (and labels or items where they say so) and no
other columns, whatever those are called. A doc_id that is null, or no number,
counts as -1.
"""
