"""Record layouts of the payer files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

_PICTURE = re.compile(r"^(S?)9\((\d+)\)(?:V9\((\d+)\))?( date| packed)?$|^X\((\d+)\)$")


@dataclass(frozen=True)
class Field:
    """One elementary field: ``kind`` is text, number, date or packed."""

    name: str
    kind: str
    digits: int
    scale: int
    signed: bool = False

    @classmethod
    def of(cls, name: str, picture: str) -> "Field":
        m = _PICTURE.match(picture)
        if not m:
            raise ValueError(f"unsupported picture {picture!r} for {name}")
        sign, whole, frac, usage, chars = m.groups()
        if chars:
            return cls(name, "text", int(chars), 0)
        scale = int(frac or 0)
        kind = {" date": "date", " packed": "packed"}.get(usage, "number")
        return cls(name, kind, int(whole) + scale, scale, bool(sign))

    def width(self, packed: bool) -> int:
        """Bytes on file; packed decimals hold two digits a byte plus a sign nibble."""
        return self.digits // 2 + 1 if packed and self.kind == "packed" else self.digits

    @property
    def type(self) -> T.DataType:
        if self.kind == "text":
            return T.StringType()
        if self.kind == "date":
            return T.DateType()
        if self.scale or self.kind == "packed":
            return T.DecimalType(self.digits, self.scale)
        if self.digits > 18:
            return T.DecimalType(self.digits, 0)
        return T.LongType() if self.digits > 9 else T.IntegerType()


@dataclass(frozen=True)
class Layout:
    fields: tuple[Field, ...]

    @classmethod
    def of(cls, *rows: tuple[str, str]) -> "Layout":
        return cls(tuple(Field.of(*row) for row in rows))

    def length(self, packed: bool) -> int:
        return sum(f.width(packed) for f in self.fields)

    def slots(self, packed: bool):
        """Pairs of field and zero-based byte offset."""
        at = 0
        for field in self.fields:
            yield field, at
            at += field.width(packed)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type) for f in self.fields])


# The record layouts of the input files, field by field.
CLAIM = Layout.of(
    ("claim_id", "9(12)"),
    ("member_id", "9(10)"),
    ("provider_id", "9(8)"),
    ("service_date", "9(8) date"),
    ("claim_type", "X(10)"),
    ("procedure_code", "X(5)"),
    ("diagnosis_code", "X(7)"),
    ("claim_amount", "9(7)V9(2) packed"),
    ("paid_amount", "9(7)V9(2) packed"),
    ("denied_amount", "9(7)V9(2) packed"),
    ("claim_status", "X(10)"),
)

SCREENING_MEMBER = Layout.of(
    ("member_id", "9(10)"),
    ("first_name", "X(20)"),
    ("last_name", "X(30)"),
    ("date_of_birth", "9(8) date"),
    ("gender", "X(1)"),
    ("age", "9(3)"),
    ("enrollment_status", "X(10)"),
    ("enrollment_months", "9(2)"),
)

SCREENING_CLAIM = Layout.of(
    ("claim_id", "9(12)"),
    ("member_id", "9(10)"),
    ("service_date", "9(8) date"),
    ("procedure_code", "X(5)"),
    ("diagnosis_code", "X(7)"),
    ("claim_amount", "9(7)V9(2) packed"),
)

CHURN_MEMBER = Layout.of(
    ("member_id", "9(10)"),
    ("first_name", "X(20)"),
    ("last_name", "X(30)"),
    ("date_of_birth", "9(8) date"),
    ("gender", "X(1)"),
    ("age", "9(3)"),
    ("enrollment_date", "9(8) date"),
    ("termination_date", "9(8) date"),
    ("enrollment_status", "X(10)"),
    ("plan_type", "X(20)"),
    ("premium_amount", "9(7)V9(2) packed"),
    ("claims_last_year", "9(5)"),
    ("total_cost_last_yr", "9(9)V9(2) packed"),
)

RISK_MEMBER = Layout.of(
    ("member_id", "9(10)"),
    ("first_name", "X(20)"),
    ("last_name", "X(30)"),
    ("date_of_birth", "9(8) date"),
    ("age", "9(3)"),
    ("gender", "X(1)"),
    ("disabled_flag", "X(1)"),
    ("original_entitled", "X(1)"),
)

DIAGNOSIS = Layout.of(
    ("member_id", "9(10)"),
    ("diagnosis_code", "X(7)"),
    ("hcc_code", "X(6)"),
    ("service_date", "9(8) date"),
    ("hcc_weight", "9(1)V9(4) packed"),
)

PROVIDER = Layout.of(
    ("provider_id", "9(8)"),
    ("provider_name", "X(50)"),
    ("provider_type", "X(20)"),
    ("specialty", "X(30)"),
    ("network_status", "X(10)"),
    ("contract_rate", "9(3)V9(2)"),
)

PROVIDER_CLAIM = Layout.of(
    ("claim_id", "9(12)"),
    ("member_id", "9(10)"),
    ("provider_id", "9(8)"),
    ("service_date", "9(8) date"),
    ("claim_amount", "9(7)V9(2) packed"),
    ("paid_amount", "9(7)V9(2) packed"),
    ("claim_status", "X(10)"),
    ("quality_score", "9(3)"),
)

PRIOR_AUTH = Layout.of(
    ("auth_id", "9(12)"),
    ("member_id", "9(10)"),
    ("provider_id", "9(8)"),
    ("request_date", "9(8) date"),
    ("approval_date", "9(8) date"),
    ("auth_status", "X(15)"),
    ("procedure_code", "X(5)"),
    ("diagnosis_code", "X(7)"),
    ("auth_amount", "9(7)V9(2) packed"),
    ("reviewer_id", "X(8)"),
)
