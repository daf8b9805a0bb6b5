"""World coordinates and provenance of outputs, as pure functions of headers."""

from __future__ import annotations

import numpy as np


def sub_axis(crval: float, crpix: float, cdelt: float, first: int, step: int) -> tuple[float, float, float]:
    """(CRVAL, CRPIX, CDELT) of every ``step``-th pixel from ``first`` on."""
    return crval, (crpix - first) / step + 1, cdelt * step


def output_cards(head: dict, x: tuple[int, int], y: tuple[int, int], third: dict | None = None) -> dict[str, object]:
    """Cards of an output over the sub-image (first, step) of both sky axes, with a third axis if any."""
    out: dict[str, object] = {}
    for k, (first, step) in ((1, x), (2, y)):
        val, pix, delt = sub_axis(float(head.get(f"CRVAL{k}", 0.0)), float(head.get(f"CRPIX{k}", 1.0)), float(head.get(f"CDELT{k}", 1.0)), first, step)
        out |= {f"CTYPE{k}": head.get(f"CTYPE{k}", ""), f"CRVAL{k}": val, f"CRPIX{k}": pix, f"CDELT{k}": delt, f"CUNIT{k}": head.get(f"CUNIT{k}", "deg")}
    if third:
        out |= {f"{name}3": value for name, value in third.items()}
    return out | frame_cards(head)


def depth_axis(rm: np.ndarray) -> dict[str, object]:
    return {"CTYPE": "FDEP", "CUNIT": "rad/m**2", "CRVAL": float(rm[0]), "CRPIX": 1.0, "CDELT": float(rm[1] - rm[0]) if len(rm) > 1 else 1.0}


def frequency_axis(crval: float, crpix: float, cdelt: float, first: int, step: int, unit: str) -> dict[str, object]:
    """A mask cube's axis, in the input's own unit."""
    val, pix, delt = sub_axis(crval, crpix, cdelt, first, step)
    return {"CTYPE": "FREQ", "CUNIT": unit, "CRVAL": val, "CRPIX": pix, "CDELT": delt}


def frame_cards(head: dict) -> dict[str, object]:
    """Rotation matrix, frame, equinox (else epoch, else 2000), poles and names that the input has."""
    out: dict[str, object] = {k: head[k] for k in ("PC1_1", "PC1_2", "PC2_1", "PC2_2", "RADESYS", "LONPOLE", "LATPOLE", "BUNIT", "OBJECT", "OBSERVER", "TELESCOP") if k in head}
    return out | {"EQUINOX": float(head.get("EQUINOX", head.get("EPOCH", 2000.0)))}


def provenance(mask_source: str, bad_channels: int, nan_check: bool, trust: str, cubestat: bool, stat_type: str = "AMP") -> dict[str, object]:
    out: dict[str, object] = {"MASKSRC": mask_source, "NBADGLOB": bad_channels, "NANCHK": nan_check, "MASKTRUS": trust, "CUBESTAT": cubestat}
    return out | ({"CSMETHOD": "TAIL_Q16_Q50", "CSTYPE": stat_type} if cubestat else {})
