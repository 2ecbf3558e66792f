"""Lemmas by noun endings. No dictionary is at hand, so this is an approximation: an exception list, then endings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCEPTIONS = {"feet": "foot", "men": "man", "women": "woman", "children": "child", "teeth": "tooth", "geese": "goose", "mice": "mouse"}
#: (ending, what takes its place); all that fit apply.
ENDINGS = (("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))

#: A lemmatizer takes a token column (lower case) and gives an array of lemmas.
Lemmatizer = Callable[[Column], Column]


def noun_lemmas(token: Column) -> Column:
    """The token itself, or its exception's lemma, and all forms by its endings."""
    exceptions = F.create_map(*[F.lit(x) for pair in EXCEPTIONS.items() for x in pair])
    known = F.element_at(exceptions, token)
    forms = [F.when(token.endswith(e) & (F.length(token) > len(e) + 1), F.concat(F.substring(token, F.lit(1), F.length(token) - len(e)), F.lit(r))) for e, r in ENDINGS]
    return F.when(known.isNotNull(), F.array(token, known)).otherwise(F.array_distinct(F.array_compact(F.array(token, *forms))))
