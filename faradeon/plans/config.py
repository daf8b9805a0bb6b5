"""Run configuration: KEY=VALUE lines to a validated record."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class RunConfig:
    path: str = "../DATA/"
    infileq: str = ""
    infileu: str = ""
    outfile: str = "output"
    remove_badchan: bool = False
    badchan_file: str = "bad_channels.txt"
    subim: bool = False
    subim_parfile: str = "subimage.par"
    subim_ra_blc: int = 1
    subim_ra_trc: int = 0
    subim_ra_inc: int = 1
    subim_dec_blc: int = 1
    subim_dec_trc: int = 0
    subim_dec_inc: int = 1
    subim_chan_blc: int = 0
    subim_chan_trc: int = 0
    subim_chan_inc: int = 1
    tile_ra: int = 0
    tile_dec: int = 0
    mem_frac_ram: float = 0.25
    mem_frac_vram: float = 0.70
    gpu_vram_mib: int = 0
    tile_auto: bool = True
    dry_run: bool = False
    rem_mean: int = 0
    remove_qu_bias: bool = False
    resiq: float = 0.0
    slopeq: float = 0.0
    resiu: float = 0.0
    slopeu: float = 0.0
    path_i: str | None = None
    infilei: str = ""
    ofac: int = 4
    fac: float = math.pi
    beg_rm: float = -50.0
    end_rm: float = 50.0
    nrm: int = 100
    use_auto_rm_range: int = 1
    output_mode: str = "ap"
    ap_angle_mode: str = "phase"
    mask_cube_file: str = ""
    mask_input_cube_file: str = ""
    mask_trust_mode: str = "safe"
    write_mask_output: bool = True
    write_nvalid_output: bool = True
    cubestat: bool = False
    use_gpu: bool = False
    io_overlap: bool = False
    io_read_threads: int = 1
    io_write_threads: int = 1
    log_level: str = "info"
    timing_enabled: bool = False
    timing_tile_enabled: bool = False
    timing_io_enabled: bool = False
    log_output_file: str = ""
    timing_csv_file: str = ""


# Other names of keys, keys that must be given, choices, and keys that Spark makes needless.
ALIASES = {"global_badchan_file": "badchan_file", "max_rm": "end_rm", "nrm_out": "nrm", "use_gpus": "use_gpu"}
REQUIRED = ("path", "infileq", "infileu", "outfile", "remove_badchan", "badchan_file", "subim", "rem_mean", "remove_qu_bias", "resiq", "slopeq", "resiu", "slopeu", "ofac", "fac", "use_auto_rm_range")
CHOICES = {"output_mode": ("ap", "ri"), "ap_angle_mode": ("phase", "pol"), "mask_trust_mode": ("safe", "strict"), "log_level": ("error", "warn", "info", "debug"), "use_auto_rm_range": (0, 1)}
HINTS = ("tile_ra", "tile_dec", "mem_frac_ram", "mem_frac_vram", "gpu_vram_mib", "tile_auto", "use_gpu", "io_overlap", "io_read_threads", "io_write_threads", "subim_parfile")

_KINDS = {f.name: str(f.type) for f in fields(RunConfig)}


def flag(text: str) -> bool:
    return text[:1].lower() in ("1", "y", "t")


def _whole(text: str) -> int:
    try:
        return int(text)
    except ValueError as e:
        raise ConfigError(f"{text!r} is no whole number") from e


def _number(text: str) -> float:
    try:
        return float(text.lower().replace("d", "e"))
    except ValueError as e:
        raise ConfigError(f"{text!r} is no number") from e


_PARSE: dict[str, Callable] = {"bool": flag, "int": _whole, "float": _number}


def pairs(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, key in lower case, value); comments start at # or ;, lines without a key or a value are skipped."""
    for n, line in enumerate(text.splitlines(), 1):
        line = line.partition("#")[0].partition(";")[0]
        key, eq, value = line.partition("=")
        if eq and key.strip() and value.strip():
            yield n, key.strip().lower(), value.strip()


def parse(text: str) -> RunConfig:
    """A record of ``text``; unknown, repeated and missing keys and values out of range raise ConfigError."""
    given: dict[str, object] = {}
    for n, name, value in pairs(text):
        key = ALIASES.get(name, name)
        if key not in _KINDS:
            raise ConfigError(f"line {n}: unknown key {name}")
        if key in given:
            raise ConfigError(f"line {n}: {key} is given twice")
        try:
            given[key] = _PARSE.get(_KINDS[key], str)(value)
        except ConfigError as e:
            raise ConfigError(f"line {n}: {key}: {e}") from e
        if key in CHOICES and isinstance(given[key], str):
            given[key] = str(given[key]).lower()
    need = list(REQUIRED)
    if given.get("use_auto_rm_range") == 0:
        need += ["beg_rm", "end_rm", "nrm"]
    if given.get("remove_qu_bias"):
        need += ["path_i", "infilei"]
    if missing := [k for k in need if k not in given]:
        raise ConfigError(f"missing: {', '.join(missing)}")
    cfg = RunConfig(**({"path_i": given["path"]} | given))
    validate(cfg)
    return cfg


def validate(cfg: RunConfig) -> None:
    checks = [(getattr(cfg, k) in v, f"{k} is none of {', '.join(map(str, v))}") for k, v in CHOICES.items()]
    checks += [(cfg.ofac >= 1, "ofac is under 1"), (cfg.nrm >= 1, "nrm is under 1"), (cfg.use_auto_rm_range == 1 or cfg.end_rm > cfg.beg_rm, "end_rm isn't over beg_rm")]
    checks += [(getattr(cfg, k) >= 0, f"{k} is under 0") for k in ("tile_ra", "tile_dec", "gpu_vram_mib")]
    checks += [(0 < getattr(cfg, k) <= 0.95, f"{k} isn't in (0, 0.95]") for k in ("mem_frac_ram", "mem_frac_vram")]
    for axis, least in (("ra", 1), ("dec", 1), ("chan", 0)):
        blc, trc, inc = (getattr(cfg, f"subim_{axis}_{k}") for k in ("blc", "trc", "inc"))
        checks += [(blc >= least, f"subim_{axis}_blc is under {least}"), (trc == 0 or trc >= blc, f"subim_{axis}_trc is under subim_{axis}_blc"), (inc >= 1, f"subim_{axis}_inc is under 1")]
    for ok, why in checks:
        if not ok:
            raise ConfigError(why)
    for k in ("use_gpu", "io_overlap"):
        if getattr(cfg, k):
            warnings.warn(f"{k} has no effect: Spark schedules the work", stacklevel=3)


def load(path: str) -> RunConfig:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def as_rows(cfg: RunConfig) -> list[tuple[str, str]]:
    return [(f.name, str(getattr(cfg, f.name))) for f in fields(cfg)]
