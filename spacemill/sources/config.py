"""Options, error codes and their texts."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Error codes, their names and messages.
ERRORS = {
    0x0001: ("Generic", "GENERAL: Generic error"),
    0x0002: ("Outofmemory", "GENERAL: Out of memory"),
    0x0003: ("InvalidParameter", "GENERAL: Invalid parameter given"),
    0x0004: ("AlreadyInitialized", "GENERAL: Already initialized"),
    0x0005: ("BatchedError", "GENERAL: More than one errors observed"),
    0x0006: ("DepedentModuleUnavailableInit", "GENERAL: A dependent module is not initialized yet. This implies a wrong initialization order in EnginePimpl."),
    0x0007: ("DepedentModuleUnavailableUninit", "GENERAL: A dependent module is already uninitialized. This implies a wrong uninitialization order in EnginePimpl."),
    0x0008: ("BeingShutdown", "GENERAL: The engine is being shutdown."),
    0x0009: ("Timeout", "GENERAL: Timeout."),
    0x000A: ("NotImplemented", "GENERAL: Not implemented yet."),
    0x000B: ("SessionExpired", "GENERAL: The session has expired."),
    0x000C: ("UserDefined", "GENERAL: User-defined error. The meaning of this error depends on the user code."),
    0x000D: ("InternalError", "GENERAL: Other uncategorized errors."),
    0x000E: ("OsMProtectFailed", "GENERAL: OS: mprotect() failed."),
    0x000F: ("EnvPrescreenFailed", "GENERAL: Pre-screening of the environment detected an issue before start up. This is caused by a misconfiguration on the environment or the given parameters. See the console output for more detailed diagnostics."),
    0x0010: ("NotSupported", "GENERAL: Operation not supported."),
    0x0110: ("EngineInvalidOption", "ENGINE : Invalid Option"),
    0x0201: ("FsAlreadyOpened", "FILESYS: Already opened"),
    0x0202: ("FsFailedToOpen", "FILESYS: Failed to open a file"),
    0x0203: ("FsFailedToClose", "FILESYS: Failed to close a file"),
    0x0204: ("FsBadSeekInput", "FILESYS: Invalid arguments for seek()"),
    0x0205: ("FsSeekFailed", "FILESYS: File seek failed"),
    0x0206: ("FsBufferTooSmall", "FILESYS: File buffer is too small"),
    0x0207: ("FsBufferNotAligned", "FILESYS: File buffer is not aligned"),
    0x0208: ("FsTooShortRead", "FILESYS: Reached end of file before completing reads"),
    0x0209: ("FsExcessRead", "FILESYS: Read more than expected"),
    0x020A: ("FsWriteFail", "FILESYS: File write failed."),
    0x020B: ("FsExcessWrite", "FILESYS: Wrote more than expected"),
    0x020C: ("FsNotOpened", "FILESYS: File not opened yet or failed to open."),
    0x020D: ("FsSyncFailed", "FILESYS: fsync() failed."),
    0x020E: ("FsMkdirFailed", "FILESYS: Failed to create a directory"),
    0x020F: ("FsTruncateFailed", "FILESYS: File truncation failed"),
    0x0210: ("FsResultNotAligned", "FILESYS: Direct I/O operation resulted in non-aligned count of bytes. Filesyste bug?"),
    0x0211: ("FsNameTooLong", "FILESYS: Pathname was too long."),
    0x0212: ("FsStatFailed", "FILESYS: stat() failed."),
    0x0213: ("FsUnlinkFailed", "FILESYS: unlink() failed."),
    0x0214: ("FsSetxattrFailed", "FILESYS: Failed to write file extended attribute."),
    0x0215: ("FsGetxattrFailed", "FILESYS: Failed to read file extended attribute."),
    0x0216: ("FsUnknownFSType", "FILESYS: Unknown file system type"),
    0x0217: ("FsNoDirectory", "FILESYS: Directory does not exist"),
    0x0301: ("MemoryNoFreePages", "MEMORY : Not enough free volatile pages. Check the config of MemoryOptions"),
    0x0302: ("MemoryDuplicateMapping", "MEMORY : Duplicate mapping in logical address space."),
    0x0303: ("MemoryUnknownMapping", "MEMORY : Unknown mapping."),
    0x0304: ("MemoryNumaUnavailable", "MEMORY : NUMA library is not available."),
    0x0305: ("MemoryMapFailed", "MEMORY : Memory map failed."),
    0x0306: ("MemoryUnmapFailed", "MEMORY : Memory unmap failed."),
    0x0307: ("MemoryInvalidAddress", "MEMORY : Invalid address."),
    0x0401: ("ConfParseFailed", "CONFIG : Config file parsing failed. This usually means an invalid YAML file."),
    0x0402: ("ConfValueOutofrange", "CONFIG : Configuration value out of range."),
    0x0403: ("ConfMissingElement", "CONFIG : The yaml element is missing in the config file."),
    0x0404: ("ConfInvalidElement", "CONFIG : An invalid valud in the xml element."),
    0x0405: ("ConfEmptyXml", "CONFIG : No root element in the xml."),
    0x0406: ("ConfFileNotFound", "CONFIG : The file doesn't exist."),
    0x0407: ("ConfCouldNotWrite", "CONFIG : Failed to write a configuration file."),
    0x0408: ("ConfCouldNotRename", "CONFIG : Failed to atomically rename the temporary file to destination."),
    0x0409: ("ConfMkdirsFailed", "CONFIG : Failed to create a directory. Check permissions."),
}
# Texts of operating-system error numbers.
ERRNOS = {0: "Success", 1: "Operation not permitted", 2: "No such file or directory", 3: "No such process", 12: "Cannot allocate memory", 22: "Invalid argument"}


def error_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, m) for c, (n, m) in ERRORS.items()], "code int, name string, message string")


def errnos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ERRNOS.items()), "errno long, text string")


def error_sql(code: str, what: str) -> str:
    text = {c: x[what == "message"].replace("'", "''") for c, x in ERRORS.items()}
    return f"case {code} " + " ".join(f"when {c} then '{x}'" for c, x in text.items()) + " end"


def errno_sql(code: str) -> str:
    return f"case {code} " + " ".join(f"when {c} then '{x}'" for c, x in ERRNOS.items()) + " end"


def layered(*layers: Column) -> Column:
    """The last layer that has a value."""
    return F.coalesce(*reversed(layers))


def _scalar(s: str):
    s = s.strip()
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s.strip("\"'")


@dataclass
class Options:
    """A tree of options, of a text of ``name: value`` lines with indented children, and back."""

    values: dict = field(default_factory=dict)

    @classmethod
    def from_text(cls, text: str) -> Options:
        root: dict = {}
        at = [(-1, root)]
        for line in text.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            depth = len(line) - len(line.lstrip())
            name, _, value = line.strip().partition(":")
            while at[-1][0] >= depth:
                at.pop()
            if value.strip():
                at[-1][1][name] = _scalar(value)
            else:
                at[-1][1][name] = child = {}
                at.append((depth, child))
        return cls(root)

    def to_text(self) -> str:
        def lines(d: dict, depth: int):
            for k, v in d.items():
                if isinstance(v, dict):
                    yield f"{' ' * depth}{k}:"
                    yield from lines(v, depth + 2)
                else:
                    yield f"{' ' * depth}{k}: {str(v).lower() if isinstance(v, bool) else v}"

        return "\n".join(lines(self.values, 0)) + "\n"

    def with_arguments(self, argv: list[str]) -> Options:
        """The options with ``--name=value`` arguments put over them."""
        names = {a.removeprefix("--").partition("=")[0] for a in argv} | set(self.values)
        p = argparse.ArgumentParser()
        for n in sorted(names):
            p.add_argument(f"--{n}", type=_scalar)
        return Options(self.values | {k: v for k, v in vars(p.parse_args(argv)).items() if v is not None})

    def get(self, name: str, default=None, required: bool = False):
        """A dotted name's value, else the default; a required one that is missing raises KeyError."""
        d = self.values
        for part in name.split("."):
            if not isinstance(d, dict) or part not in d:
                if required:
                    raise KeyError(name)
                return default
            d = d[part]
        return d

    def flat(self) -> dict:
        def walk(d: dict, prefix: str):
            for k, v in d.items():
                if isinstance(v, dict):
                    yield from walk(v, f"{prefix}{k}.")
                else:
                    yield prefix + k, v

        return dict(walk(self.values, ""))
