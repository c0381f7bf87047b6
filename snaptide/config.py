"""Settings of a session and of its commands, with their defaults, read from --name=value options without case."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

#: Small-file settings of the reading presets: parallel reads, factor for small files, bytes that count as small.
READ_PRESETS = {"hd": (1, 2, 10_000), "ssd": (2, 2, 500_000), "network": (1, 2, 2_000_000)}


@dataclass(frozen=True)
class Config:
    db: str = "IndexedFiles"
    dry_run: bool = False
    verbose: bool = False
    log_level: str = "info"
    progress_window: bool = True
    confirmations: bool = True
    excluded_paths: tuple[str, ...] = ()
    excluded_files: tuple[str, ...] = ()
    time_zone: str = "UTC"
    fast_mode: bool = True
    ignore_hash_in_fast_mode: bool = False
    create_hash_only_for_first_mb: bool = False
    create_thumbnails: bool = False
    thumbnail_size: int = 600
    always_check_hash_on_index_for_files_suffix: tuple[str, ...] = ()
    allow_multithreading: bool = True
    max_threads: int = 10
    max_changed_files_warning_percent: int = 5
    min_allowed_changes: int = 50
    min_disk_free_space_percent: int = 10
    min_disk_free_space_mb: int = 1000
    read_config: str = "hd"
    included_paths: tuple[str, ...] = ()
    index_archive_contents: bool = True
    medium_description: str | None = None
    medium_serial: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def with_options(self, named: dict[str, str]) -> Config:
        """A copy with options put in; names it doesn't know go to extra."""
        known = {f.name.replace("_", ""): f for f in fields(self) if f.name != "extra"}
        put, rest = {}, {}
        for name, value in named.items():
            f = known.get(name.lower())
            if f is None:
                rest[name.lower()] = value
            else:
                put[f.name] = _read(value, getattr(self, f.name), f.name)
        return replace(self, **put, extra={**self.extra, **rest})

    def lines(self) -> list[str]:
        """One line a setting, for the status command."""
        return [f"{f.name} = {getattr(self, f.name)}" for f in fields(self)]


def _read(value: str, default: object, name: str) -> object:
    if isinstance(default, bool):
        if value.lower() not in ("yes", "no", "true", "false", "1", "0"):
            raise ValueError(f"{name} is yes or no, not {value}")
        return value.lower() in ("yes", "true", "1")
    if isinstance(default, int):
        return int(value)
    if isinstance(default, tuple):
        return tuple(sorted({x.strip() for x in value.strip("{}").split(",") if x.strip()}))
    if name == "read_config" and value.lower() not in READ_PRESETS:
        raise ValueError(f"no preset {value}")
    return value
