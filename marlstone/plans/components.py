"""Parts of a run by name: embedder, generator, expander and writer of hypothetical answers, from settings or the environment."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from marlstone.operators import rerank

KINDS = ("embedder", "generator", "expander", "writer")


@dataclass(frozen=True)
class Choice:
    """Which part is used of each kind, and what remote parts need to be called."""

    embedder: str = "mock"
    generator: str = "mock"
    expander: str = "mock"
    writer: str = "mock"
    project: str = ""
    region: str = ""
    embedding_model: str = ""
    generator_model: str = ""

    @classmethod
    def of(cls, env: Mapping[str, str], prefix: str = "") -> Choice:
        """From variables by the names of the fields in capitals; what is blank or not there is as by default."""
        found = {f.name: env.get(f"{prefix}{f.name.upper()}", "").strip() for f in fields(cls)}
        return cls(**{k: v for k, v in found.items() if v})


@dataclass(frozen=True)
class Parts:
    """What a run calls, inside tasks: so each part must be picklable and open its client where it is used.

    embed: texts to vectors, none for the hashed embedder; generate: a prompt to an answer, none for the stand-in;
    expand: (question, n) to paraphrases; write: a question to a hypothetical answer."""

    embed: Callable | None = None
    generate: Callable | None = None
    expand: Callable = rerank.template_paraphrases
    write: Callable = rerank.template_answer


_FIELD = {"embedder": "embed", "generator": "generate", "expander": "expand", "writer": "write"}
_makers: dict[tuple[str, str], tuple[Callable[[Choice], Callable], tuple[str, ...]]] = {}


def register(kind: str, name: str, maker: Callable[[Choice], Callable], needs: tuple[str, ...] = ()) -> None:
    """A maker of parts under a name; `needs` are fields of the choice that must not be blank. A name given again is replaced."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; there are {', '.join(KINDS)}")
    if name == "mock":
        raise ValueError("mock parts are built in")
    if unknown := [n for n in needs if n not in {f.name for f in fields(Choice)}]:
        raise ValueError(f"no settings {unknown}")
    _makers[kind, name] = maker, tuple(needs)


def parts(choice: Choice = Choice()) -> Parts:
    """Parts as chosen. A name that nobody registered is a ValueError; a part whose needs are blank is a RuntimeError, raised
    before anything runs."""
    made = {}
    for kind in KINDS:
        name = getattr(choice, kind)
        if name == "mock":
            continue
        if (kind, name) not in _makers:
            raise ValueError(f"unknown {kind} {name!r}")
        maker, needs = _makers[kind, name]
        if missing := [n for n in needs if not getattr(choice, n)]:
            raise RuntimeError(f"{kind} {name!r} needs {', '.join(missing)}")
        made[_FIELD[kind]] = maker(choice)
    return Parts(**made)
