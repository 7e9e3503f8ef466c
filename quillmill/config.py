"""What the environment says about completion services."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Service:
    """A service's model where none is named, and the variables that hold its key and address."""

    model: str
    keys: tuple[str, ...] = ()
    address: str = ""
    url: str = ""


# Variables, addresses and models that are used when nothing else is said.
SERVICES = {
    "ollama": Service("llama3.2:3b", address="OLLAMA_HOST", url="http://localhost:11434"),
    "openai": Service("gpt-4o-mini", ("OPENAI_API_KEY",), "OPENAI_BASE_URL", "https://api.openai.com/v1"),
    "gemini": Service("gemini-2.5-flash", ("GEMINI_API_KEY", "GOOGLE_API_KEY")),
}
USUAL = "ollama"
PROVIDER, MODEL = "QUILLMILL_PROVIDER", "QUILLMILL_MODEL"


def web_address(host: str) -> str:
    """``host`` with a scheme and no slash at its end."""
    bare = host.strip().rstrip("/")
    return bare if not bare or "://" in bare else f"http://{bare}"


class Environment:
    """Answers for each service, looked up when asked for; blank variables count as unset.

    Only the variables that matter are kept, so that an instance can be sent to workers.
    """

    def __init__(self, variables: Mapping[str, str] | None = None):
        given = os.environ if variables is None else variables
        names = {PROVIDER, MODEL} | {n for s in SERVICES.values() for n in (*s.keys, s.address) if n}
        self._set = {n: v for n in names if (v := given.get(n, "").strip())}

    @property
    def provider(self) -> str:
        return self._set.get(PROVIDER, USUAL).lower()

    def model(self, provider: str) -> str:
        """The model that is set for all services, or the service's usual one ("" for unknown services)."""
        usual = SERVICES[provider].model if provider in SERVICES else ""
        return self._set.get(MODEL, usual)

    def key(self, provider: str) -> str | None:
        return next((self._set[n] for n in SERVICES[provider].keys if n in self._set), None)

    def own_url(self, provider: str) -> str | None:
        """The address that is set, or None."""
        return web_address(self._set.get(SERVICES[provider].address, "")) or None

    def url(self, provider: str) -> str:
        return self.own_url(provider) or SERVICES[provider].url
