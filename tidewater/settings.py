"""Settings from keyword arguments or the environment, and path allowlists."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

# Embedding models and their dimensions.
EMBED_MODELS = {"minilm-l6-v2": 384, "mpnet-base-v2": 768, "distilbert-base": 768}
PREFIX = "TIDEWATER_"


def parse_duration(raw: str) -> float:
    """Seconds of a duration such as ``1s``, ``5m``, ``1h30m`` or ``250ms``."""
    if raw.strip() in ("0", ""):
        return 0.0
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|us|ns|s|m|h)", raw)
    if "".join(a + b for a, b in parts) != raw.strip():
        raise ValueError(f"bad duration {raw!r}")
    unit = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
    return sum(float(n) * unit[u] for n, u in parts)


def parse_bool(raw: str | None, default: bool = False) -> bool:
    if raw is None or not raw.strip():
        return default
    return raw.strip().lower() in ("1", "true", "yes", "on")


def parse_positive(name: str, raw: str | None, default: int) -> int:
    if raw is None or not raw.strip():
        return default
    value = int(raw)
    if value <= 0:
        raise ValueError(f"{name} must be positive")
    return value


def _unique(paths: list[str]) -> list[str]:
    return list(dict.fromkeys(os.path.abspath(p) for p in paths if p.strip()))


@dataclass(frozen=True)
class Settings:
    roots: list[str]
    index_dir: str
    path_base: str | None = None
    watch_paths: list[str] = field(default_factory=list)
    watch_debounce: float = 1.0
    watch_rescan: float = 0.0
    max_file_bytes: int = 2 * 1024 * 1024
    max_extract_bytes: int = 512 * 1024
    max_chunks: int = 64
    chunk_bytes: int = 3072
    overlap_bytes: int = 256
    embed_batch: int = 1
    embed_model: str = "minilm-l6-v2"
    embed_backend: str = "none"
    text_only: bool = False
    extract_timeout: float = 30.0
    web_key: str | None = None
    web_url: str | None = None
    ocr: bool = True
    ocr_language: str = "eng"

    def __post_init__(self) -> None:
        object.__setattr__(self, "roots", _unique(self.roots))
        object.__setattr__(self, "watch_paths", _unique(self.watch_paths))
        if not self.roots:
            raise ValueError("at least one root is needed")
        if self.embed_model not in EMBED_MODELS:
            raise ValueError(f"unknown embed model {self.embed_model!r}")
        if self.embed_backend not in ("none", "inline", "hash"):
            raise ValueError(f"unknown embed backend {self.embed_backend!r}")
        if self.overlap_bytes >= self.chunk_bytes:
            raise ValueError("overlap must be smaller than the chunk")
        if min(self.watch_debounce, self.watch_rescan, self.extract_timeout) < 0:
            raise ValueError("durations must not be negative")
        for p in [*self.watch_paths, *([self.path_base] if self.path_base else [])]:
            if not self.under_any_root(os.path.abspath(p)):
                raise ValueError(f"{p} is outside the roots")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ if env is None else env)
        get = lambda name: env.get(PREFIX + name)
        split = lambda raw: [x.strip() for x in (raw or "").split(",") if x.strip()]
        return cls(
            roots=split(get("ROOTS")),
            index_dir=get("INDEX_DIR") or os.path.join(os.path.expanduser("~"), ".tidewater"),
            path_base=get("PATH_BASE") or None,
            watch_paths=split(get("WATCH_PATHS")),
            watch_debounce=parse_duration(get("WATCH_DEBOUNCE") or "1s"),
            watch_rescan=parse_duration(get("WATCH_RESCAN") or "0"),
            max_file_bytes=parse_positive("MAX_FILE_BYTES", get("MAX_FILE_BYTES"), 2 * 1024 * 1024),
            max_extract_bytes=parse_positive("MAX_EXTRACT_BYTES", get("MAX_EXTRACT_BYTES"), 512 * 1024),
            max_chunks=parse_positive("MAX_CHUNKS", get("MAX_CHUNKS"), 64),
            chunk_bytes=parse_positive("CHUNK_BYTES", get("CHUNK_BYTES"), 3072),
            overlap_bytes=parse_positive("OVERLAP_BYTES", get("OVERLAP_BYTES"), 256),
            embed_batch=parse_positive("EMBED_BATCH", get("EMBED_BATCH"), 1),
            embed_model=get("EMBED_MODEL") or "minilm-l6-v2",
            embed_backend=get("EMBED_BACKEND") or "none",
            text_only=parse_bool(get("TEXT_ONLY")),
            extract_timeout=parse_duration(get("EXTRACT_TIMEOUT") or "30s"),
            web_key=get("WEB_KEY") or None,
            web_url=get("WEB_URL") or None,
            ocr=parse_bool(get("OCR"), True),
            ocr_language=get("OCR_LANGUAGE") or "eng",
        )

    def under_any_root(self, path: str) -> bool:
        return any(path == r or path.startswith(r.rstrip("/") + "/") for r in self.roots)

    def candidates(self, path: str) -> list[str]:
        """Absolute paths that a given path may mean, existing or not."""
        if not path.strip() or path.strip() in (".", "./"):
            raise ValueError("empty path")
        if os.path.isabs(path):
            whole = os.path.normpath(path)
            if not self.under_any_root(whole):
                raise PermissionError(f"{path} is outside the roots")
            return [whole]
        bases = [*([os.path.abspath(self.path_base)] if self.path_base else []), *self.roots]
        joined = list(dict.fromkeys(os.path.normpath(os.path.join(b, path)) for b in bases))
        found = [p for p in joined if self.under_any_root(p)]
        if not found:
            raise PermissionError(f"{path} is outside the roots")
        return found

    def resolve(self, path: str) -> str:
        """The one existing path that is meant; the path base comes first."""
        found = [p for p in self.candidates(path) if os.path.exists(p)]
        if not found:
            raise FileNotFoundError(path)
        base = os.path.abspath(self.path_base) if self.path_base else None
        if base and (found[0] == base or found[0].startswith(base.rstrip("/") + "/")):
            return found[0]
        if len(found) > 1:
            raise ValueError(f"{path} is ambiguous: {', '.join(found)}")
        return found[0]


def local_limit(n: int) -> int:
    return 10 if n <= 0 else min(n, 50)
