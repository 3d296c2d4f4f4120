"""confab: conversation analytics and moment search as Spark DataFrame plans."""
