"""Where a remote object store is and how to enter it: the environment first, then a mapping of secrets."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class StorageSettings:
    url: str = ""
    key: str = ""
    bucket: str = ""
    folder: str = ""

    @property
    def configured(self) -> bool:
        """Whether the store can be asked at all; the folder may be empty."""
        return bool(self.url and self.key and self.bucket)

    def path(self, name: str) -> str:
        return "/".join(x.strip("/") for x in (self.url, self.bucket, self.folder, name) if x)


def read_settings(secrets: Mapping[str, str] | None = None, prefix: str = "GLEANER_STORAGE_", environ: Mapping[str, str] | None = None) -> StorageSettings:
    """Each field from ``prefix`` + its name in capitals in the environment, else from the secrets, else empty."""
    env, secrets = os.environ if environ is None else environ, secrets or {}
    pick = lambda n: (env.get(n) or secrets.get(n) or "").strip()
    return StorageSettings(**{f.name: pick(prefix + f.name.upper()) for f in fields(StorageSettings)})
