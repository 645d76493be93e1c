"""Prompt and chat columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom.constants import (
    BACK_TRANSLATION_PROMPT,
    REGION_NAMES,
    SYSTEM_PROMPTS,
    TO_DIALECT_PROMPT,
    TO_STANDARD_PROMPT,
)
from pairloom.functions.text import col

TEMPLATES: dict[str, str] = dict(SYSTEM_PROMPTS)


def register_template(name: str, system: str) -> None:
    TEMPLATES[name] = system


def system_prompt(template: str = "default") -> str:
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template!r}; registered: {sorted(TEMPLATES)}")
    return TEMPLATES[template]


def _fill(pattern: str, *values: Column) -> Column:
    """Constant pieces of a `%s` pattern joined with columns (any text is safe inside)."""
    pieces = pattern.split("%s")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value, F.lit(piece)]
    return F.concat(*parts)


def region_name(do: Column | str) -> Column:
    """Display name of a region; an unknown code passes through."""
    table = F.create_map(*[F.lit(x) for pair in REGION_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col(do)), col(do))


def user_prompt(source: Column | str, do: Column | str, direction: Column | str) -> Column:
    name, text = region_name(do), col(source)
    return F.when(col(direction) == "std2dia", _fill(TO_DIALECT_PROMPT, name, text)).otherwise(
        _fill(TO_STANDARD_PROMPT, name, text)
    )


def back_translation_prompt(text: Column | str) -> Column:
    return _fill(BACK_TRANSLATION_PROMPT, col(text))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_messages(
    source: Column | str, do: Column | str, direction: Column | str, template: str = "default"
) -> Column:
    return F.array(
        _message("system", F.lit(system_prompt(template))),
        _message("user", user_prompt(source, do, direction)),
    )


def chat_messages(
    source: Column | str,
    target: Column | str,
    do: Column | str,
    direction: Column | str,
    template: str = "default",
) -> Column:
    return F.array(
        _message("system", F.lit(system_prompt(template))),
        _message("user", user_prompt(source, do, direction)),
        _message("assistant", col(target)),
    )


def render_chat(
    messages: Column | str,
    generation_cue: bool = False,
    turn: str = "[%s] %s",
    separator: str = "\n",
    cue: str = "[assistant]",
) -> Column:
    """Messages as one string. The wire format belongs to a model, so it is an argument."""
    body = F.array_join(
        F.transform(col(messages), lambda m: _fill(turn, m["role"], m["content"])), separator
    )
    return F.concat(body, F.lit(separator + cue)) if generation_cue else body
