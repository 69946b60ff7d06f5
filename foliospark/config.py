"""Engine parameters, passed explicitly; nothing is kept in global state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    match_threshold: float = 0.55
    #: Without a visual score a match needs this geometric score.
    blind_threshold: float = 0.85
    #: A visual score up to this counts as none.
    visual_floor: float = 0.05
    visual_weight: float = 0.60
    anchor_weight: float = 0.5
    anchor_text_threshold: float = 0.7
    anchor_image_threshold: float = 0.3
    anchor_fit_max_error: float = 0.15
    anchor_max_anisotropy: float = 6.0
    anchor_max_shear: float = 0.2
    refine_below: float = 80.0
    review_below: float = 40.0
    top_k: int = 3
    price_in: float = 0.27
    price_out: float = 1.10
    euro: float = 0.93
    #: Back-ends that answer prompts, in the order of their priority; the local one is always there.
    hosted_enabled: bool = False
    hosted_key: str = ""
    hosted_url: str = ""
    remote_url: str = ""
    remote_key: str = ""
    local_url: str = "http://localhost"


def generation_backend(config: EngineConfig) -> tuple[str, str, dict[str, str]]:
    """Name, address and headers of the back-end that answers prompts: the hosted one if it is enabled and has a key, else a remote one, else the local one."""
    if config.hosted_enabled and config.hosted_key:
        return "hosted", config.hosted_url.rstrip("/"), {"Authorization": f"Bearer {config.hosted_key}", "Content-Type": "application/json"}
    headers = {"Authorization": f"Bearer {config.remote_key}"} if config.remote_key else {}
    return ("remote", config.remote_url.rstrip("/"), headers) if config.remote_url else ("local", config.local_url.rstrip("/"), headers)
