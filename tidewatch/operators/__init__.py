"""Detection, scoring and case operators over validated events."""
