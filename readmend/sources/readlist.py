"""Read lists: one file name a line, mates on adjacent lines."""

from __future__ import annotations

from readmend.config import ConfigError
from readmend.sources import files


def _stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    if name.endswith(".gz"):
        name = name[:-3]
    return name.rsplit(".", 1)[0]


def read_list(path: str, paired: bool = True) -> list[list[str]]:
    """Groups of files corrected together: pairs, or single files."""
    names = [line.strip() for line in files.read_text(path).splitlines() if line.strip()]
    if not names:
        raise ConfigError(f"{path} names no files")
    if not paired:
        return [[n] for n in names]
    if len(names) % 2:
        raise ConfigError(f"{path} names an odd number of files; mates come in pairs")
    return [names[i:i + 2] for i in range(0, len(names), 2)]


def group_prefix(prefix: str, group: list[str]) -> str:
    """Output prefix of one group: the run's, then the files' names."""
    return ".".join([prefix, *map(_stem, group)])
