"""Filing plans for exported conversations, expressed as Spark DataFrame programs."""

from foldwise.plans.move_plan import MovePlan, PlanParameters, build_move_plan, write_plan

__all__ = ["MovePlan", "PlanParameters", "build_move_plan", "write_plan"]
