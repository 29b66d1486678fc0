"""Business settings every operator takes as arguments.

Each dataclass can be replaced by the caller; the defaults are the published support policy.
"""
from __future__ import annotations

from dataclasses import dataclass, field

# Service targets in minutes, contact rates in rupees, teams, priced events.
SLA_TARGET_MINUTES = {"chat": 15, "email": 480, "voice": 120, "social": 240}
CONTACT_RATE_INR = {"chat": 210, "email": 260, "voice": 520, "social": 240}
BLENDED_CONTACT_RATE_INR = 290
TRANSFER_RATE_INR = 305
SLA_CREDIT_INR = 350
REPLACEMENT_LOGISTICS_INR = 340
TIER1_TEAMS = ("Chat Frontline", "Email Frontline", "Voice Frontline")
TIER2_MARKER = "Warranty"
PRIMARY_SYSTEM = "helpdesk"
LEGACY_SYSTEM = "legacy_fd"
DONE_STATUSES = ("resolved", "closed")
STATUSES = ("open", "pending", "resolved", "closed")

# Stored category -> theme.
CATEGORY_THEMES = {
    "Connectivity": "Connectivity & Pairing",
    "Charging & Battery": "Charging & Battery",
    "Audio Quality": "Audio Quality & Mic",
    "App & Firmware": "App & Firmware",
    "Delivery & Shipping": "Delivery & Shipping",
    "Returns & Refunds": "Returns & Refunds",
    "Billing & Payments": "Billing & Payments",
    "Warranty & Repair": "Warranty & Repair",
    "Account & Login": "Account & Help",
    "Product Enquiry": "Product Enquiry",
}
OTHER_THEME = "Other / Unclassified"

# Theme -> patterns, in tie-break order (the earliest theme wins).
KEYWORD_PATTERNS = {
    "Connectivity & Pairing": [r"\bpair\w*\b", r"\bbluetooth\b", r"\bconnect\w*\b", r"\bdisconnect\w*\b", r"\bwifi\b", r"\bwi-fi\b", r"\bsignal\b", r"\brang\w*\b", r"\bstutter\w*\b"],
    "Charging & Battery": [r"\bbatter\w*\b", r"\bcharg\w*\b", r"\bdrain\w*\b", r"\bbackup\b", r"\bled\b", r"\bgreen light\b", r"\bdie[sd]?\b", r"\bdischarg\w*\b"],
    "Audio Quality & Mic": [r"\bsound\w*\b", r"\baudio\b", r"\bmic\b", r"\bhiss\b", r"\bhear\w*\b", r"\bvolum\w*\b", r"\bnois\w*\b", r"\bsilent\b", r"\bone side\b", r"\bbuds?\b"],
    "App & Firmware": [r"\bapp\b", r"\bfirmware\b", r"\bupdat\w*\b", r"\bcrash\w*\b", r"\botp\b", r"\blogin\b", r"\blog in\b", r"\bwhite screen\b"],
    "Delivery & Shipping": [r"\bdeliver\w*\b", r"\bcourier\b", r"\btrack\w*\b", r"\bshipped\b", r"\bship\w*\b", r"\bpickup\b", r"\bpick up\b", r"\bdispatch\w*\b", r"\bparcel\b", r"\bpackag\w*\b", r"\baddress\w*\b", r"\bpincode\b", r"\bpin code\b"],
    "Returns & Refunds": [r"\brefund\w*\b", r"\breturn\w*\b", r"\bmoney back\b", r"\bpicked up\b", r"\breplac\w*\b", r"\breship\w*\b"],
    "Billing & Payments": [r"\bpayment\b", r"\bpay\b", r"\bcharged twice\b", r"\bdoubl\w*\b", r"\bcoupon\b", r"\bdiscount\b", r"\binvoic\w*\b", r"\bgst\w*\b", r"\bprice\b", r"\boffer\w*\b", r"\bbank\b", r"\bdebit\w*\b"],
    "Warranty & Repair": [r"\bwarrant\w*\b", r"\brepair\w*\b", r"\bservice centre\b", r"\bservice center\b", r"\brma\b", r"\bclaim\b"],
    "Account & Help": [r"\baccount\b", r"\botp\b", r"\blogin\b", r"\bpassword\b", r"\baddress\w*\b", r"\bcompatib\w*\b", r"\bsamsung\b", r"\biphone\b", r"\btv\b"],
    "Product Enquiry": [r"\bcompatib\w*\b", r"\bbefore i buy\b", r"\bwill this\b"],
}

# Digest triggers.
OTHER_SHARE_TRIGGER_PCT = 15
OTHER_GROWTH_TRIGGER_PP = 3
SPIKE_TRIGGER = 10
EMAIL_TAIL_TRIGGER = 10
REPEAT_TRIGGER = 60


@dataclass(frozen=True)
class SupportPolicy:
    """Targets, rates and team sets used by the weekly figures."""

    sla_minutes: dict[str, int] = field(default_factory=lambda: dict(SLA_TARGET_MINUTES))
    contact_rates: dict[str, int] = field(default_factory=lambda: dict(CONTACT_RATE_INR))
    blended_rate: int = BLENDED_CONTACT_RATE_INR
    transfer_rate: int = TRANSFER_RATE_INR
    sla_credit: int = SLA_CREDIT_INR
    tier1_teams: tuple[str, ...] = TIER1_TEAMS
    tier2_marker: str = TIER2_MARKER
    primary_system: str = PRIMARY_SYSTEM
    legacy_system: str = LEGACY_SYSTEM
    done_statuses: tuple[str, ...] = DONE_STATUSES
    statuses: tuple[str, ...] = STATUSES


@dataclass(frozen=True)
class ThemeRules:
    """Stored-category map plus ordered keyword patterns."""

    category_themes: dict[str, str] = field(default_factory=lambda: dict(CATEGORY_THEMES))
    patterns: dict[str, list[str]] = field(default_factory=lambda: dict(KEYWORD_PATTERNS))
    other: str = OTHER_THEME


DEFAULT_POLICY = SupportPolicy()
DEFAULT_RULES = ThemeRules()
