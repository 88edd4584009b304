from lexsieve.plans.normalize import STAGES, normalize

__all__ = ["STAGES", "normalize"]
