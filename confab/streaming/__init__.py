"""confab.streaming"""
