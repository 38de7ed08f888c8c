"""pixelweave: image-stack, trace and particle-track analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
