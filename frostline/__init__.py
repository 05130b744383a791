"""Cold-row archiving and range partitioning as Spark jobs."""

from frostline.spec import ArchiveJob, PartitionSpec, Retention, ValueKind

__all__ = ["ArchiveJob", "PartitionSpec", "Retention", "ValueKind"]
