"""Wording of questions and model instructions, by purpose and language."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import ConfigError

# Outputs depend on these texts.
QUESTIONS = {
    "section": {"en": "Explain: {title}.", "pt-br": "Explique: {title}."},
    "subsection": {"en": "In the context of {parent}, explain: {title}.", "pt-br": "No contexto de {parent}, explique: {title}."},
    "continue": {"en": "Continue the following text.\n\n{context}", "pt-br": "Continue o texto a seguir.\n\n{context}"},
    "blank": {"en": "Fill in the blank marked ____ in the following text.\n\n{text}", "pt-br": "Preencha a lacuna marcada com ____ no texto a seguir.\n\n{text}"},
}
#: What a model is told; ``{n}`` and ``{text}`` are filled in.
INSTRUCTIONS = {
    "pairs": {
        "en": "Write {n} question and answer pairs that the text below supports, in its language.\n\n{text}",
        "pt-br": "Escreva {n} perguntas com respostas que o texto abaixo sustente.\n\n{text}",
    },
    "items": {
        "en": "Write {n} tasks with an instruction, an optional input and an output, supported by the text below.\n\n{text}",
        "pt-br": "Escreva {n} tarefas com instrução, entrada opcional e saída, sustentadas pelo texto abaixo.\n\n{text}",
    },
    "again": {"en": "Answer again with the JSON object and nothing else.", "pt-br": "Responda de novo apenas com o objeto JSON."},
}
LANGUAGES = ("en", "pt-br")


@dataclass(frozen=True)
class Wording:
    """The texts of one language; ``changed`` gives a copy with other texts for some purposes."""

    lang: str
    texts: Mapping[str, str]

    def __getitem__(self, purpose: str) -> str:
        return self.texts[purpose]

    def changed(self, **texts: str) -> Wording:
        if unknown := sorted(set(texts) - set(self.texts)):
            raise ConfigError(f"unknown purposes: {', '.join(unknown)}")
        return replace(self, texts={**self.texts, **texts})

    def column(self, purpose: str, **parts: Column) -> Column:
        """The purpose's text with its places filled by columns."""
        pieces = re.split(r"\{(\w+)\}", self[purpose])
        return F.concat(*(parts[x] if i % 2 else F.lit(x) for i, x in enumerate(pieces) if i % 2 or x))

    def filled(self, purpose: str, **parts: object) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: str(parts.get(m[1], m[0])), self[purpose])


def wording(lang: str = "en") -> Wording:
    """Texts of a language by its tag, in any case, with ``-`` or ``_``, with or without its region."""
    tag = lang.lower().replace("_", "-")
    found = next((x for x in LANGUAGES if x == tag or x.startswith(f"{tag}-")), None) if tag else None
    if found is None:
        raise ConfigError(f"no wording for language {lang!r}; there is {' and '.join(LANGUAGES)}")
    return Wording(found, {purpose: texts[found] for purpose, texts in (QUESTIONS | INSTRUCTIONS).items()})
