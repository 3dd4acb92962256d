"""Errors: one base with an optional detail, and a branch for each part of the library."""


class VeilError(Exception):
    def __init__(self, message: str, *, detail: str | None = None) -> None:
        super().__init__(message)
        self.detail = detail


class IngestError(VeilError):
    """A source can't be read."""


class UnsupportedFormatError(IngestError):
    """No reader for this kind of file."""


class FHIRValidationError(IngestError):
    """JSON that isn't a bundle."""


class HL7ParseError(IngestError):
    """Text that isn't an HL7v2 message."""


class DeidentificationError(VeilError):
    """A layer of de-identification failed."""


class PHIDetectionError(DeidentificationError):
    """Detection failed."""


class DateShiftError(DeidentificationError):
    """A range of offsets or a date is unusable."""


class PrivacyError(VeilError):
    """A privacy guarantee can't be given."""


class BudgetExhaustedError(PrivacyError):
    def __init__(self, epsilon_remaining: float) -> None:
        super().__init__(f"privacy budget exhausted: {epsilon_remaining:.6f} epsilon remaining")
        self.epsilon_remaining = epsilon_remaining


class KAnonymityError(PrivacyError):
    """A class is smaller than k, or holds fewer than l sensitive values."""


class SyntheticDataError(VeilError):
    """Synthesis failed."""


class ReidentificationRiskError(SyntheticDataError):
    """Synthetic records lie too near real ones."""


class AuditError(VeilError):
    """The audit trail is broken."""


class LineageError(AuditError):
    """A lineage node is missing."""


class PipelineError(VeilError):
    """A pipeline step failed."""


class PipelineConfigError(PipelineError):
    """The pipeline's settings contradict each other."""
