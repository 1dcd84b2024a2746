"""Run manifests, signatures and bundles of reports; all of it metadata on the driver."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from typing import Any

_EPOCH = (1980, 1, 1, 0, 0, 0)
MAX_FILES, MAX_BYTES = 32, 16 << 20


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, no NaN: equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def run_manifest(dataset_fingerprint: str, configuration: dict[str, Any], stages: list[dict[str, Any]], status: str, version: str = "1") -> dict[str, Any]:
    """What was run on what, with a signature over data, configuration and version."""
    config = fingerprint(configuration)
    signature = fingerprint({"dataset": dataset_fingerprint, "configuration": config, "version": version})
    return {"version": version, "dataset_fingerprint": dataset_fingerprint, "configuration_fingerprint": config, "run_signature": signature, "status": status, "stages": stages}


def compare_manifests(old: dict[str, Any], new: dict[str, Any]) -> dict[str, str]:
    """MATCH or DIFFERENT for each part, and EXACT, PARTIAL or NONE over all."""
    parts = {k: "MATCH" if old.get(k) == new.get(k) else "DIFFERENT" for k in ("dataset_fingerprint", "configuration_fingerprint", "version")}
    same = sum(v == "MATCH" for v in parts.values())
    return parts | {"overall": "EXACT" if same == len(parts) else "PARTIAL" if same else "NONE"}


def write_bundle(files: dict[str, str]) -> bytes:
    """A ZIP of text files in name order with a fixed date and a signed list of their hashes; the same bytes for the same files."""
    listed = {name: hashlib.sha256(text.encode()).hexdigest() for name, text in files.items()}
    every = files | {"manifest.json": canonical_json({"files": listed, "signature": fingerprint(listed)})}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(every):
            info = zipfile.ZipInfo(name, _EPOCH)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, every[name])
    return out.getvalue()


def verify_bundle(content: bytes) -> list[str]:
    """What is wrong with a bundle; nothing if it is sound. Odd names, too many or too large files are not opened."""
    problems: list[str] = []
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return ["not a ZIP archive"]
    names = z.namelist()
    if len(names) > MAX_FILES or sum(i.file_size for i in z.infolist()) > MAX_BYTES:
        return ["too many or too large files"]
    if len(set(names)) < len(names):
        problems.append("duplicate names")
    problems += [f"unsafe name: {n}" for n in names if n.startswith(("/", "\\")) or ".." in n.split("/") or ":" in n]
    problems += [f"symbolic link: {i.filename}" for i in z.infolist() if (i.external_attr >> 16) & 0o170000 == 0o120000]
    if problems:
        return problems
    if "manifest.json" not in names:
        return ["no manifest.json"]
    manifest = json.loads(z.read("manifest.json"))
    listed = manifest.get("files", {})
    if manifest.get("signature") != fingerprint(listed):
        problems.append("the signature differs")
    for name in sorted(set(names) - {"manifest.json"} | set(listed)):
        if name not in listed:
            problems.append(f"not listed: {name}")
        elif name not in names:
            problems.append(f"missing: {name}")
        elif hashlib.sha256(z.read(name)).hexdigest() != listed[name]:
            problems.append(f"changed: {name}")
    return problems


def preset_to_json(preset: dict[str, Any]) -> str:
    return json.dumps(preset, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False)


def preset_missing_columns(preset: dict[str, Any], columns: list[str]) -> list[str]:
    """Columns that a preset names and the table doesn't have."""
    named = [preset.get("target"), preset.get("timestamp"), *preset.get("features", []), *preset.get("identifiers", [])]
    return [c for c in dict.fromkeys(named) if c and c not in columns]
