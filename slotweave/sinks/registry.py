"""A schema registry's client over a pluggable transport, as the wire format's ids need it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote

from slotweave.sources.scan import Transient, pauses, retried

#: (method, path, body) -> (status, body); raises ``Transient`` where no answer came.
Transport = Callable[[str, str, dict | None], tuple[int, dict]]


class RegistryError(RuntimeError):
    def __init__(self, status: int, message: str):
        super().__init__(f"{status}: {message}")
        self.status = status


@dataclass
class SchemaRegistry:
    """Registers schemas by subject and remembers their ids. Busy servers are asked again."""

    transport: Transport
    kind: str = "PROTOBUF"
    retries: int = 3
    first_pause: float = 0.2
    known: dict[tuple[str, str], int] = field(default_factory=dict)

    def _ask(self, method: str, path: str, body: dict | None = None) -> dict:
        def go() -> dict:
            status, answer = self.transport(method, path, body)
            if status == 429 or status >= 500:
                raise Transient(f"{status}: {answer}")
            if status >= 400:
                raise RegistryError(status, answer.get("message", json.dumps(answer)))
            return answer

        return retried(go, waits=lambda: pauses(self.first_pause, 10.0, self.retries))

    def id_of(self, subject: str, schema: str) -> int:
        """The schema's id under the subject; it is registered if it isn't yet."""
        if (subject, schema) not in self.known:
            answer = self._ask("POST", f"/subjects/{quote(subject, safe='')}/versions", {"schemaType": self.kind, "schema": schema})
            self.known[subject, schema] = int(answer["id"])
        return self.known[subject, schema]

    def schema_of(self, schema_id: int) -> str:
        return self._ask("GET", f"/schemas/ids/{schema_id}")["schema"]

    def latest(self, subject: str) -> tuple[int, str] | None:
        """(id, schema) of a subject's last version, None if it has none."""
        try:
            answer = self._ask("GET", f"/subjects/{quote(subject, safe='')}/versions/latest")
        except RegistryError as e:
            if e.status == 404:
                return None
            raise
        return int(answer["id"]), answer["schema"]
