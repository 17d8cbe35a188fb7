"""Thresholds, labels and texts used by the operators.

Everything here is data: pass a changed instance to an operator to change its
behaviour.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Voucher type labels of each ledger category (exact match).
VOUCHER_TYPES = {
    "Sales": ("GST Sales New", "GST SALES NEW 25-26"),
    "Purchase": ("Purchase", "Purchase New"),
    "Purchase Order": ("Purchase Order",),
    "Receipt": ("Receipt", "Receipt New", "Receipt 25-26"),
    "Payment": ("Payment", "Payment New"),
    "Journal": ("Journal New",),
    "Contra": ("Contra",),
    "Credit Note": ("Credit Note New",),
    "Debit Note": ("Debit Note New",),
    "Delivery Challan": ("Delivery Challan", "Delivery Challan New"),
}

# Ordered contains-rules of the pattern categoriser.
CATEGORY_PATTERNS = (
    "Sales",
    "Purchase",
    "Payment",
    "Receipt",
    "Journal",
    "Contra",
    "Debit Note",
    "Credit Note",
)

OTHER = "Other"

# Rows of a raw day book that are not vouchers.
REPEATED_HEADER_MARKS = ("Date", "Inwards Qty")
SUMMARY_PARTIES = ("nan", "total", "closing balance", "opening balance", "")
SUMMARY_PREFIXES = ("total", "grand")

LAKH = 100_000
CRORE = 10_000_000


# Band edges, scores and weights of published results.
@dataclass(frozen=True)
class RfmConfig:
    """Right-closed bands: ``edges[i] < x <= edges[i + 1]`` scores ``scores[i]``;
    a last edge of None leaves the last band open above."""

    recency_edges: tuple = (-1, 15, 45, 90, 180, None)
    recency_scores: tuple = (5, 4, 3, 2, 1)
    frequency_edges: tuple = (0, 3, 10, 30, 100, None)
    frequency_scores: tuple = (1, 2, 3, 4, 5)
    monetary_edges: tuple = (0, 100_000, 500_000, 1_000_000, 5_000_000, None)
    monetary_scores: tuple = (1, 2, 3, 4, 5)
    # percent weights, so that the score stays exact in integers
    weights: tuple = (30, 30, 40)


# Weights, cuts and labels of published results.
@dataclass(frozen=True)
class RfmMinMaxConfig:
    weights: tuple = (0.35, 0.25, 0.40)
    # left-open label ranges; at or below the first cut there is no label
    cuts: tuple = (0.0, 0.33, 0.66, 1.0)
    labels: tuple = ("At Risk", "Growing", "Champion")


# Fence factor and least rows of published results.
@dataclass(frozen=True)
class IqrConfig:
    min_rows: int = 5
    factor: str = "1.5"


# Tier edges of published results.
@dataclass(frozen=True)
class PaymentConfig:
    excellent: int = 95
    good: int = 85
    moderate: int = 70
    never_paid_days: int = 999
    never_paid_text: str = "No payment"


# Day limits of published results.
@dataclass(frozen=True)
class ChurnConfig:
    active_days: int = 30
    low_days: int = 90
    medium_days: int = 180
    # order in which statuses are listed
    order: tuple = (
        "Churned",
        "High Risk",
        "Medium Risk",
        "Low Risk",
        "Active",
        "New Customer",
    )
    at_risk: tuple = ("Churned", "High Risk", "Medium Risk")


# Limits of published results.
@dataclass(frozen=True)
class MarginConfig:
    healthy: int = 35
    warning: int = 20
    critical: int = 0
    alpha: float = 1.0
    targets: tuple = (40, 35, 30, 25, 20, 15)
    labels: tuple = ("Healthy", "Warning", "Critical", "Loss")


@dataclass(frozen=True)
class ForecastConfig:
    horizon: int = 6
    replicas: int = 500
    confidence: int = 90
    step_after: int = 12


@dataclass(frozen=True)
class ActionTexts:
    """Recommended actions per label; ``contact`` is who makes the calls."""

    contact: str = "the owner"
    rfm: dict = field(default_factory=dict)
    churn: dict = field(default_factory=dict)
    payment: dict = field(default_factory=dict)

    @staticmethod
    def default(contact: str = "the owner") -> "ActionTexts":
        # Action text of each label.
        return ActionTexts(
            contact=contact,
            rfm={
                "Champion": "Nurture — offer loyalty pricing or early access to new products",
                "Loyal": "Retain — regular check-ins, ensure satisfaction",
                "At Risk": f"Re-engage — personal call from {contact} within 30 days",
                "Promising": "Grow — increase order frequency with small incentives",
                "Lost": "Investigate — find out why they stopped ordering",
            },
            churn={
                "Churned": f"Urgent — personal call from {contact}, understand why they left",
                "High Risk": "Re-engage immediately — offer incentive or check satisfaction",
                "Medium Risk": "Follow up this week — confirm next order timeline",
                "Low Risk": "Check in — ensure no issues with last delivery",
                "Active": "Maintain — keep service quality high",
                "New Customer": "Nurture — ensure smooth onboarding, follow up on experience",
            },
            payment={
                "Advance Payer": "Prioritise — they pay ahead, reward with best service",
                "Excellent": "Maintain — keep relationship strong",
                "Good": "Monitor — follow up on outstanding balance",
                "Moderate Risk": "Follow up — send formal payment reminder",
                "High Risk": f"Urgent — escalate to {contact} for direct call",
            },
        )


# Flag texts of the two-sided range check.
FLAG_HIGH = "HIGH — unusually large"
FLAG_LOW = "LOW — unusually small"
