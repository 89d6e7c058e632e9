"""Configuration from TOML, and back to it."""

from __future__ import annotations

import json
import os
import secrets
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from tallyhold.errors import ConfigError
from tallyhold.operators.chunking import DEFAULT_AVERAGE, LEAST_AVERAGE


#: What a scan may be told, each true or false.
SCAN = ("follow_symlinks", "cross_mounts", "respect_gitignore")


@dataclass(frozen=True)
class Config:
    """roots to scan, globs to leave out, the store's URI, and the sections chunking, encryption, machine, retention, scan.

    The file holds no secret: of the store's keys it has the names of the environment variables that hold them.
    """

    roots: list[str]
    store: str
    excludes: list[str] = field(default_factory=list)
    store_options: dict[str, str] = field(default_factory=dict)
    average_chunk: int = DEFAULT_AVERAGE
    encryption: bool = False
    key_file: str | None = None
    retain_seconds: int | None = None
    salt_file: str | None = None
    scan_options: dict[str, str] = field(default_factory=dict)
    key_names: tuple[str, str] | None = None

    @classmethod
    def parse(cls, text: str) -> Config:
        try:
            raw = tomllib.loads(text)
            remote, names = raw["remote"], None
            kind = remote.get("kind", "local")
            if kind in ("local", "filesystem"):
                store, options = remote["path"], {}
            elif kind in ("r2", "s3"):
                store = f"s3a://{remote['bucket']}/{remote.get('prefix', '')}".rstrip("/")
                # without names the store's own chain of credentials counts
                names = (remote["access_key_id_env"], remote["secret_access_key_env"]) if "access_key_id_env" in remote else None
                options = {"fs.s3a.endpoint": remote["endpoint"], "fs.s3a.endpoint.region": remote.get("region", "auto")}
            else:
                raise ConfigError(f"remote.kind {kind!r} isn't known")
            average = int(raw.get("chunking", {}).get("average", DEFAULT_AVERAGE))
            if average < LEAST_AVERAGE:
                raise ConfigError(f"chunking.average is at least {LEAST_AVERAGE}")
            keep = raw.get("retention", {}).get("retain_after_secs")
            scan = {name: str(bool(raw["scan"][name])).lower() for name in SCAN if name in raw.get("scan", {})}
            secret = raw.get("encryption", {})
            return cls([str(r) for r in raw["roots"]], store, list(raw.get("excludes", [])), options, average, bool(secret.get("enabled", False)), raw.get("machine", {}).get("key_file"), None if keep is None else int(keep), secret.get("salt_path"), scan, names)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(str(e)) from e
        except KeyError as e:
            raise ConfigError(f"{e.args[0]} is missing") from e

    @classmethod
    def load(cls, path: str) -> Config:
        return cls.parse(Path(path).read_text("utf-8"))

    def dump(self) -> str:
        """The TOML that ``parse`` reads as this configuration."""
        lines = [f"roots = {json.dumps(self.roots)}", f"excludes = {json.dumps(self.excludes)}", "[remote]"]
        if self.store.startswith("s3a://"):
            bucket, _, prefix = self.store.removeprefix("s3a://").partition("/")
            own = {"kind": "s3", "bucket": bucket, "prefix": prefix, "endpoint": self.store_options["fs.s3a.endpoint"], "region": self.store_options["fs.s3a.endpoint.region"]}
            own |= dict(zip(("access_key_id_env", "secret_access_key_env"), self.key_names or (), strict=False))
        else:
            own = {"kind": "local", "path": self.store}
        lines += [f"{k} = {json.dumps(v)}" for k, v in own.items()]
        sections = {
            "chunking": {"average": self.average_chunk},
            "encryption": {"enabled": self.encryption, "salt_path": self.salt_file},
            "machine": {"key_file": self.key_file},
            "retention": {"retain_after_secs": self.retain_seconds},
            "scan": {k: v == "true" for k, v in self.scan_options.items()},
        }
        for name, values in sections.items():
            lines += [f"[{name}]", *(f"{k} = {json.dumps(v)}" for k, v in values.items() if v is not None)]
        return "\n".join(lines) + "\n"

    def write(self, path: str) -> None:
        Path(path).write_text(self.dump(), "utf-8")

    def secrets(self) -> dict[str, str]:
        """The store's keys, from the environment variables that the configuration names."""
        if not self.key_names:
            return {}
        lacking = [name for name in self.key_names if name not in os.environ]
        if lacking:
            raise ConfigError(f"{' and '.join(lacking)} isn't set")
        return dict(zip(("fs.s3a.access.key", "fs.s3a.secret.key"), map(os.environ.__getitem__, self.key_names), strict=True))

    def salt(self) -> bytes:
        """The salt of a passphrase: what the salt file has, which is made at first use."""
        if not self.salt_file:
            raise ConfigError("encryption.salt_path is missing")
        path = Path(self.salt_file)
        if not path.exists():
            path.parent.mkdir(parents=True, exist_ok=True)
            with open(path, "xb") as f:
                f.write(secrets.token_bytes(16))
        salt = path.read_bytes()
        if len(salt) < 16:
            raise ConfigError(f"{path} has less than 16 bytes")
        return salt
