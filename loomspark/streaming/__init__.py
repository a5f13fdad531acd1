"""No streaming operator exists in the capabilities this engine covers, so there is none here. Incremental work is batch: see
``loomspark.operators.labelling`` and ``loomspark.plans.saved``."""
