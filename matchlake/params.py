"""Model parameters: one frozen struct, passed to every scoring operator."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values (they define the results) ---------------------------------

HARDPOINT = "Hardpoint"
SEARCH = "Search & Destroy"
OVERLOAD = "Overload"
CONTROL = "Control"

# order of modes in a scored series, and in the map-by-map rotation
SERIES_MODES = (HARDPOINT, SEARCH, OVERLOAD, HARDPOINT, SEARCH)
ROTATION_MODES = (HARDPOINT, SEARCH, CONTROL, HARDPOINT, SEARCH)

# short team names used in document names
TEAM_SHORT_NAMES = {
    "Atlanta FaZe": "FaZe",
    "Boston Breach": "Breach",
    "Carolina Royal Ravens": "Ravens",
    "Cloud9 New York": "Cloud9",
    "FaZe Vegas": "FaZe",
    "G2 Minnesota": "G2",
    "LA Guerrillas M8": "Guerrillas",
    "Los Angeles Thieves": "Thieves",
    "Miami Heretics": "Heretics",
    "Minnesota ROKKR": "ROKKR",
    "OpTic Texas": "OpTic",
    "Paris Gentle Mates": "Mates",
    "Riyadh Falcons": "Falcons",
    "Toronto KOI": "KOI",
    "Toronto Ultra": "Ultra",
    "Vancouver Surge": "Surge",
    "Vegas Falcons": "Falcons",
}

# logo file -> team
TEAM_LOGOS = {
    "TX-OpTic-color-darkmode.png": "OpTic Texas",
    "ATL-FaZe-color-darkmode.png": "Atlanta FaZe",
    "BOS-Breach-color-darkmode.png": "Boston Breach",
    "CAR_ROYAL_RAVENS_ALLMODE.webp": "Carolina Royal Ravens",
    "Cloud9_New_York_darkmodee.webp": "Cloud9 New York",
    "Los_Angeles_Guerrillas_M8logo_square.webp": "LA Guerrillas M8",
    "LA-Thieves-color-allmode.png": "Los Angeles Thieves",
    "MIA_HERETICS_ALLMODE.webp": "Miami Heretics",
    "Minnesota_ROKKR_RED.webp": "Minnesota ROKKR",
    "TO-Ultra-color-darkmode.png": "Toronto Ultra",
    "SEA-Surge-color-allmode.png": "Vancouver Surge",
    "Las_Vegas_Falconslogo_square.webp": "Vegas Falcons",
}

# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class ModelParams:
    """Defaults are the published rules; override per call where a rule is a choice."""

    roster_size: int = 4
    # time decay: exp(-rate * days), clamped; undated rows get a middle weight
    decay_rate: float = 0.693 / 30
    decay_floor: float = 0.01
    undated_weight: float = 0.5
    momentum_last: int = 5
    # recent context
    context_last: int = 5
    default_rest_days: float = 30.0
    # score difference multiplier of a mode win
    diff_scale: float = 300.0
    diff_min: float = 0.5
    diff_max: float = 1.5
    # share of chemistry (the rest is roster quality) by weighted history
    series_history_high: float = 8.0
    series_history_mid: float = 4.0
    mode_history_high: float = 6.0
    mode_history_mid: float = 3.0
    chemistry_high: float = 0.7
    chemistry_mid: float = 0.5
    chemistry_low: float = 0.3
    win_share: float = 0.7
    quality_kd: float = 0.6
    quality_rating: float = 0.3
    quality_damage: float = 0.1
    momentum_share: float = 0.15
    momentum_span: float = 25.0
    h2h_step: float = 0.05
    h2h_max: float = 0.15
    mode_h2h_step: float = 0.08
    mode_h2h_max: float = 0.20
    mode_h2h_fallback_max: float = 0.10
    series_modes: tuple = SERIES_MODES
    rotation_modes: tuple = ROTATION_MODES
    first_to: int = 3
    # ratings
    rating_start: float = 1500.0
    rating_k: float = 32.0
    rating_blowout: float = 0.8
    rating_keep: float = 0.8
    rating_scale: float = 400.0
    # learned features
    h2h_min_meetings: int = 3
    h2h_full_meetings: float = 5.0
    # ensemble weights of the documented variant
    weight_statistical: float = 0.40
    weight_rating: float = 0.35
    weight_learned: float = 0.25
    high_confidence: float = 30.0

    @property
    def decay_horizon(self) -> int:
        """Largest whole number of days whose decay is still above the floor."""
        from math import log

        return int(log(1 / self.decay_floor) / self.decay_rate)


DEFAULTS = ModelParams()
