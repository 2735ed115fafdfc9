"""Prompts as string columns.

A prompt is a sequence of literal parts (``str``) and columns. Variables are
bound by name, because they are columns; a NULL variable gives a NULL prompt.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Models whose prompts need an end-of-turn token.
END_OF_TURN = {"llama-3.1-8b": "<|eot_id|>"}


def end_of_turn(model: Column | str) -> Column:
    """The end-of-turn token of a model, empty for models without one."""
    model = F.lit(model) if isinstance(model, str) else model
    token = F.lit("")
    for name, value in END_OF_TURN.items():
        token = F.when(model == name, F.lit(value)).otherwise(token)
    return token


def prompt(*parts: Column | str) -> Column:
    """Concatenate literal parts and columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def document_lines(documents: Column) -> Column:
    """Retrieved documents, one per line, in the order of the array.

    ``documents`` is an array of structs with a ``content`` field.
    """
    return F.array_join(
        F.transform(documents, lambda d: F.concat(F.lit("    "), d["content"])), "\n"
    )


def scored_document_lines(
    documents: Column, decimals: int = 4, as_similarity: bool = False
) -> Column:
    """As :func:`document_lines`, with the ``score`` field of each document.

    The score is a cosine distance and is labelled so; ``as_similarity`` prints
    ``1 - distance`` instead.
    """
    label = "cosine similarity" if as_similarity else "cosine distance"

    def line(d: Column) -> Column:
        score = F.lit(1.0) - d["score"] if as_similarity else d["score"]
        shown = F.round(score, decimals).cast(f"decimal(38,{decimals})").cast("string")
        return F.concat(F.lit("    "), d["content"], F.lit(f" ({label} = "), shown, F.lit(")"))

    return F.array_join(F.transform(documents, line), "\n")


def naming_prompt(
    informal_name: Column,
    instruction: str,
    model: Column | str,
    context: Column | None = None,
) -> Column:
    """Instruction, optional retrieved terms, the informal name, the token."""
    parts: list[Column | str] = [instruction, "\n\n"]
    if context is not None:
        parts += ["Possible related terms:\n", context, "\n\n"]
    parts += ["Informal name: ", informal_name, end_of_turn(model), "\nResponse:"]
    return prompt(*parts)
