"""Questions in natural language to queries: prompt, answer, check. Nothing is run."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from sluice.errors import QueryError

# Parts of field names that are never told to a provider.
DENIED = ("secret", "token", "password", "passwd", "pass", "api_key", "apikey", "hash", "private", "credential", "bearer", "authorization", "auth_header", "client_secret", "key")


@dataclass(frozen=True)
class Answer:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


class Provider(Protocol):
    def complete(self, system: str, user: str, max_tokens: int) -> Answer: ...


@dataclass(frozen=True)
class Outcome:
    query: str
    valid: bool
    error: str | None
    retried: bool
    prompt_tokens: int
    completion_tokens: int


def redact_fields(fields: Sequence[str], denied: Sequence[str] = DENIED, allowed: Sequence[str] = ()) -> list[str]:
    """Field names without those that hold a denied part, unless allowed by name."""
    free = {a.lower() for a in allowed}
    return [f for f in fields if f.lower() in free or not any(d in f.lower() for d in denied)]


def prompt(fields: Sequence[str], categories: Sequence[str], question: str) -> tuple[str, str]:
    system = (
        "Translate the question into one query of a pipe language. Answer with the query alone, on one line, without prose or code marks. "
        "A query starts with search and has stages parted by |. Use only fields of the schema. Never write SQL. "
        "Stages: where, stats <aggregate> by <fields>, timechart, eval <field>=<expression>, sort, head <n>, table, dedup, rename a AS b, eventstats, top, rare.\n"
        "Example: search category=auth action=failure | stats count by host | sort -count"
    )
    return system, f"Schema: {', '.join(fields)}\nCategories: {', '.join(categories)}\nQuestion: {question.strip()}\nQuery:"


def extract_query(text: str) -> str:
    """The query in an answer: in a code block if there is one, the first line that looks like one."""
    block = re.search(r"```(?:[A-Za-z0-9]+\n|\s)?(.*?)```", text, re.S)
    lines = [re.sub(r"^(?:(?:R|SOQL|Query):\s*)+", "", x.strip()) for x in (block[1] if block else text).strip().splitlines()]
    lines = [x for x in lines if x]
    return next((x for x in lines if x.lower().startswith("search") or "|" in x), lines[0] if lines else "")


def ask(provider: Provider, question: str, fields: Sequence[str], categories: Sequence[str], check: Callable[[str], object], max_tokens: int = 256, **policy) -> Outcome:
    """One query for a question; a query that check refuses is asked for once more.

    check parses or builds (Engine.query does) and raises QueryError; the query is
    never run here.
    """
    known = redact_fields(fields, **policy)
    system, user = prompt(known, categories, question)
    spent, error, query = [0, 0], None, ""
    for retried in (False, True):
        answer = provider.complete(system, user, max_tokens)
        spent = [spent[0] + answer.prompt_tokens, spent[1] + answer.completion_tokens]
        query = extract_query(answer.text)
        try:
            check(query)
            return Outcome(query, True, None, retried, *spent)
        except QueryError as why:
            error = str(why)
            user = f"{prompt(known, categories, question)[1]}\nThe query {query!r} was refused: {error}\nCorrect it. Answer with the query alone.\nQuery:"
    return Outcome(query, False, error, True, *spent)
