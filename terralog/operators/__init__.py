"""DataFrame operators over many entities at once; every window is partitioned by its entity."""
