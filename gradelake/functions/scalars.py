"""Driver-side scalars: canonical JSON, seeds, revisions, commitments and signatures. Each value of a wrong form is an error."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from typing import Any

from gradelake.config import PROTOCOL, Protocol

# Forms of ids, and the fields of a compact commitment with their limit in bytes.
REPO = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,95}/[A-Za-z0-9][A-Za-z0-9_.-]{0,95}")
REVISION = re.compile(r"[0-9a-f]{40}")
DIGEST = re.compile(r"[0-9a-f]{64}")
ROW_ID = r"\A[A-Za-z0-9][A-Za-z0-9_.:/-]{0,191}\z"
COMMITMENT, COMMITMENT_BYTES = {"p": "protocol", "m": "model_repo", "r": "model_revision", "h": "digest", "d": "rollout_repo"}, 512


def canonical_json(value: Any) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def hash_json(value: Any) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def strict_json(raw: bytes, limit: int) -> Any:
    """JSON of at most ``limit`` bytes of UTF-8, without repeated keys and without NaN or infinities."""
    if len(raw) > limit:
        raise ValueError(f"over {limit} bytes of JSON")

    def once(pairs: list[tuple[str, Any]]) -> dict:
        found = dict(pairs)
        if len(found) != len(pairs):
            raise ValueError("a key is repeated")
        return found

    def never(name: str) -> None:
        raise ValueError(f"{name} is no JSON number")

    return json.loads(raw.decode(), object_pairs_hook=once, parse_constant=never)


def block_hash(text: str) -> str:
    """The one form of a block's hash: 0x and 64 lower-case hex digits."""
    found = re.fullmatch(r"(?:0x)?([0-9a-f]{64})", str(text).strip().lower())
    if not found:
        raise ValueError("a block hash has 32 bytes in hex digits")
    return f"0x{found[1]}"


def evaluation_seed(network: int, window: int, block: str, protocol: Protocol = PROTOCOL) -> str:
    return hash_json({"domain": f"{protocol.domain}/evaluation", "network": network, "window": window, "block_hash": block_hash(block)})


def audit_seed(network: int, block: str, hotkey: str, digest: str, revision: str, number: int, protocol: Protocol = PROTOCOL) -> str:
    return hash_json({"domain": f"{protocol.domain}/audit", "network": network, "block_hash": block_hash(block), "hotkey": hotkey, "digest": digest, "revision": revision, "round": number})


def _form(pattern: re.Pattern, value: Any, what: str) -> str:
    if not isinstance(value, str) or not pattern.fullmatch(value):
        raise ValueError(f"{value!r} is no {what}")
    return value


def revision(text: str) -> str:
    """An immutable revision: 40 hex digits."""
    return _form(REVISION, text.lower(), "revision of 40 hex digits")


def commitment_bytes(fields: dict[str, str]) -> bytes:
    """A commitment (protocol, model_repo, model_revision, digest, rollout_repo) in its compact form."""
    raw = canonical_json({short: fields[name] for short, name in COMMITMENT.items()})
    commitment_fields(raw)
    return raw


def commitment_fields(raw: bytes | str | dict) -> dict[str, str]:
    """The fields of a compact commitment: exactly its keys, each of its form."""
    found = raw if isinstance(raw, dict) else strict_json(raw.encode() if isinstance(raw, str) else raw, COMMITMENT_BYTES)
    if not isinstance(found, dict) or set(found) != set(COMMITMENT):
        raise ValueError("a commitment has unknown or missing fields")
    if len(canonical_json(found)) > COMMITMENT_BYTES:
        raise ValueError(f"a commitment has at most {COMMITMENT_BYTES} bytes")
    out = {name: str(found[short]) for short, name in COMMITMENT.items()}
    for name, form in (("model_repo", REPO), ("model_revision", REVISION), ("digest", DIGEST), ("rollout_repo", REPO)):
        _form(form, out[name], name)
    return out


def sign(payload: Any, key: bytes, key_id: str) -> dict[str, str]:
    return {"key_id": key_id, "alg": "hmac-sha256", "sig": hmac.new(key, canonical_json(payload), hashlib.sha256).hexdigest()}


def signed(payload: Any, signature: dict[str, str], keys: dict[str, bytes]) -> bool:
    """Whether the signature is that of a known key over the payload, compared in constant time."""
    key = keys.get(signature.get("key_id", ""))
    return key is not None and hmac.compare_digest(sign(payload, key, signature["key_id"])["sig"], str(signature.get("sig", "")))
