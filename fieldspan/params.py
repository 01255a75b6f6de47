"""Constants of the analysis, all in one frozen table; every operator takes them as a parameter."""

from __future__ import annotations

from dataclasses import dataclass

# Zone names and sets, and thresholds that results depend on.
BEHIND_NET, KEY, NET_TO_8, PERIMETER, BEYOND_30 = "Behind Net", "Key", "Net-to-8", "Perimeter", "Beyond 30"
ALL_ZONES = (BEHIND_NET, KEY, NET_TO_8, PERIMETER, BEYOND_30)
PLAY_ZONES = (BEHIND_NET, KEY, NET_TO_8, PERIMETER)
DEEP_ZONES = (BEHIND_NET, KEY, NET_TO_8)
NEAR_NET_ZONES = (KEY, BEHIND_NET)
FORMATION_ZONES = (BEHIND_NET, NET_TO_8, PERIMETER)
CUT_ZONES = (NET_TO_8, PERIMETER)
DIAGNOSTIC_ZONES = (BEHIND_NET, KEY, PERIMETER)
GOALIE, UNKNOWN = "Goalie", "Unknown"


@dataclass(frozen=True)
class Params:
    fps: float = 30.0
    period_sec: float = 900.0
    bucket_sec: float = 0.5
    # possession signal
    strict_off: int = 6
    strict_def: int = 6
    strict_deep: int = 3
    loose_off: int = 5
    loose_def: int = 5
    grace_buckets: int = 18
    sustained_buckets: int = 6
    end_pad_sec: float = 4.0
    perimeter_share: float = 0.7
    huddle_players: int = 4
    huddle_ratio: float = 3.0
    # off-screen credit
    credit_min_detections: int = 5
    credit_edge_share: float = 0.95
    credit_max_sec: float = 8.0
    # splitting and matching
    long_block_sec: float = 150.0
    split_buffer_sec: float = 45.0
    match_window_sec: float = 150.0
    # tracking
    track_max_gap: int = 90
    track_px_per_frame: float = 12.0
    track_base_px: float = 40.0
    track_cap_px: float = 500.0
    track_full_width: float = 3840.0
    # interpolation
    stride: int = 3
    max_interp_gap: int = 30
    max_interp_widths: float = 8.0
    # clock alignment
    quiet_count: int = 1
    quiet_samples: int = 6
    huddle_samples: int = 3
    anchor_radius_sec: float = 90.0
    goal_delay_sec: float = 2.5
    bad_anchor_ratio: float = 1.6
    # formations and cuts
    roster_floor: int = 7
    min_zone_run: int = 3
    # sampling and diagnostics
    low_count: int = 4
    low_count_sec: float = 3.0
    sibling_gap_sec: float = 15.0
    unmatched_pad_sec: float = 20.0
    probe_within_sec: float = 15.0
    probe_step_sec: float = 5.0
    probe_pad_sec: float = 10.0


DEFAULTS = Params()
