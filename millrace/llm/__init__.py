"""Training-data operators.

Ten operators over large text, page and vector tables, each in its own module
as a general DataFrame -> DataFrame function, plus :mod:`millrace.llm.entry`
with the thin contract queries.  Nothing else in ``millrace`` imports this
package.
"""
