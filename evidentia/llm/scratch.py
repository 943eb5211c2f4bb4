"""The folder that driver and executors share for intermediate tables."""

from ..sources.shared import shared_folder

__all__ = ["shared_folder"]
