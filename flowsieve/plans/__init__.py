"""End-to-end plans: stand-in inputs, label preparation, dataset build."""
